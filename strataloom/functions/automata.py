"""States of a small automaton along ordered rows, as a prefix scan over ranges of rows.

A row's symbol maps states to states, and such maps compose.  So rows are dealt into sorted ranges,
each range composes the maps of its rows from its own first row on, and the state in which a range begins follows
from the ranges before it, one row each.  One very long document is many ranges, and nothing waits for what
stands before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged

#: States of an automaton at most: a map is kept as one long, six bits a state.
MOST_STATES = 10


def _composed(maps: np.ndarray) -> np.ndarray:
    """maps[i] after all of maps[:i], for rows of state maps; in about log2(n) steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], 1)
        step *= 2
    return out


def _coded(maps: np.ndarray) -> np.ndarray:
    return (maps.astype(np.int64) << (6 * np.arange(maps.shape[1]))).sum(axis=1)


def states(rows: DataFrame, group: Sequence[str], order: Sequence[str], symbol: Column, table: Sequence[Sequence[int]], out: str, start: int = 0) -> DataFrame:
    """Add ``out``: the automaton's state before each row of its ``group`` in ``order``; it begins with ``start``.

    ``table[state][symbol]`` is the next state; a null symbol leaves the state as it is.  Rows of one place in ``order`` have no
    defined order among them.  Nulls in ``group`` are a group.  Columns named __g, __s, __map and __part are the helper's own.
    """
    n = len(table)
    if not 0 < n <= MOST_STATES:
        raise ValueError(f"{n} states")
    steps = np.array([*np.array(table).T.tolist(), list(range(n))], np.int64)  # by symbol; the last one changes nothing
    kept = rows.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = np.arange(n)[None, :], None  # the map from the range's first row on, and the group
        for batch in batches:
            if not batch.num_rows:
                continue
            g, s = np.asarray(batch.column("__g")), np.asarray(batch.column("__s"))
            fresh = np.concatenate([[last is not None and g[0] != last], g[1:] != g[:-1]])
            # before a row: what came before it, but the start at a group's first row
            before = np.concatenate([held, steps[s]])
            begins = np.append(fresh, False)
            upto = []
            a = 0
            for b in [*np.flatnonzero(begins[1:]) + 1, len(before) - 1]:  # a group at a time, so what a reset cuts off isn't composed
                part = before[a : b + 1].copy()
                if begins[a]:
                    part[0] = start
                upto.append(_composed(part)[:-1])
                carried = _composed(part)[-1]
                a = b
            upto = np.concatenate(upto)
            held, last = carried[None, :], g[-1]
            codes = pa.array(_coded(upto))
            after = pa.array(_coded(np.take_along_axis(steps[s], upto, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("__g"), codes, after, batch.column("__part")], names=[*kept, "__g", "__map", "__after", "__part"])

    marked = rows.withColumn("__g", F.xxhash64(*group)).withColumn("__s", F.coalesce(symbol.cast("int"), F.lit(len(steps) - 1)))
    dealt = marked.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("__part", F.monotonically_increasing_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    mapped = staged(dealt.mapInArrow(scan, f"{fields}, __g bigint, __map bigint, __after bigint, __part bigint"), "states")
    part = F.shiftright("__part", 33)
    ends = mapped.groupBy(part.alias("p")).agg(F.min_by("__g", "__part").alias("first"), F.max_by("__g", "__part").alias("last"), F.max_by("__after", "__part").alias("map")).orderBy("p").collect()  # a row a range
    begin, now, before = [], start, None
    for r in ends:
        now = now if r.first == before else start
        begin.append((r.p, now))
        now, before = r.map >> 6 * now & 63, r.last
    starts = rows.sparkSession.createDataFrame(begin, "__p bigint, __begin int")
    joined = mapped.join(F.broadcast(starts), part == F.col("__p"))
    state = F.expr("cast(shiftright(__map, 6 * __begin) & 63 as int)")
    found = joined.withColumn(out, state)
    result = found.select(*kept, out)
    result._staged_at = getattr(mapped, "_staged_at", None)
    return result


def done_with(found: DataFrame) -> None:
    """Delete what ``states`` has staged for a result that nothing reads any more."""
    discard(found)


#: In code fences: 0 outside, 1 inside; symbols: 0 another line, 1 a fence, 2 a heading, behind which a section begins outside.
FENCES = ((0, 1, 0), (1, 0, 0))
#: In a listing: symbols 0 opens it, 1 closes it.
LISTINGS = ((1, 0), (1, 0))
#: Blank lines pending, 2 for two or more: symbols 0 a blank line, 1 a line that doesn't count, 2 any other.
PENDING = ((1, 0, 0), (2, 1, 0), (2, 2, 0))
