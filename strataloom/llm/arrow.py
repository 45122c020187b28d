"""Bounded Arrow batches for the operators that leave the JVM; see functions/arrow.py."""

from __future__ import annotations

from ..functions.arrow import BATCH_BYTES, BATCH_ROWS, _bytes, bound_batches, give_back

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "_bytes", "bound_batches", "give_back"]
