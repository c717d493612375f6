"""Greedy packing of sentences into overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window sizes in characters.
MAX_CHARS = 500
MIN_CHARS = 300
OVERLAP = 75

_SPILL = 256


def pack(
    sents: Column,
    max_chars: int = MAX_CHARS,
    min_chars: int = MIN_CHARS,
    overlap: int = OVERLAP,
) -> Column:
    """Windows over an array of sentences.

    The open window is the only state, so one fold over the array is enough.
    Closed windows wait in ``part`` and move to ``full`` in groups, which keeps
    the fold linear for a text of any length.
    """
    none = F.array().cast("array<string>")
    start = F.struct(
        F.array().cast("array<array<string>>").alias("full"),
        none.alias("part"),
        F.lit("").alias("cur"),
    )

    def step(acc: Column, s: Column) -> Column:
        cur, part = acc["cur"], acc["part"]
        too_long = F.length(s) > max_chars
        fits = F.length(cur) + F.length(s) <= max_chars
        cuts = F.transform(
            F.sequence(F.lit(0), F.floor((F.length(s) - 1) / max_chars).cast("int")),
            lambda i: s.substr(i * max_chars + 1, F.lit(max_chars)),
        )
        closed = (
            F.when(too_long, F.concat(F.when(cur != "", F.array(cur)).otherwise(none), cuts))
            .when(fits, none)
            .otherwise(F.array(cur))
        )
        spilled = F.size(part) >= _SPILL
        return F.struct(
            F.when(spilled, F.concat(acc["full"], F.array(part))).otherwise(acc["full"]).alias("full"),
            F.concat(F.when(spilled, none).otherwise(part), closed).alias("part"),
            F.when(too_long, F.lit(""))
            .when(fits, F.concat(cur, s))
            .otherwise(F.concat(F.right(cur, F.lit(overlap)), s))
            .alias("cur"),
        )

    def finish(acc: Column) -> Column:
        # The closed windows and the open one; the tail rule is applied outside the fold.
        return F.struct(
            F.flatten(F.concat(acc["full"], F.array(acc["part"]))).alias("out"), acc["cur"].alias("cur")
        )

    state = F.aggregate(sents, start, step, finish)

    def close(st: Column) -> Column:
        out, cur = st["out"], st["cur"]
        merged = F.concat(
            F.slice(out, F.lit(1), F.size(out) - 1),
            F.array(F.concat(F.element_at(out, -1), cur)),
        )
        return (
            F.when(cur == "", out)
            .when((F.size(out) > 0) & (F.length(cur) < min_chars), merged)
            .otherwise(F.concat(out, F.array(cur)))
        )

    return F.element_at(F.transform(F.array(state), close), 1)
