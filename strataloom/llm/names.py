"""Names for an operator's own columns beside the input's."""

from __future__ import annotations

from collections.abc import Iterable


def own(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it none of ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
