"""Ordered state without one task per key.

A window over ``doc_id`` puts a whole document into one task. The helpers
here split each key into ranges of its order column, summarise the ranges,
carry the summaries forward and finish inside each range. A range holds at most
``width`` rows of a unique integer order, so a key with a third of all rows is
spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import cut

WIDTH = 1 << 16

_REDUCE = {"max": F.max, "min": F.min, "sum": F.sum}


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    wins = before > here if kind == "max" else before < here
    return F.when(here.isNull() | wins, F.coalesce(before, here)).otherwise(here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    states: Mapping[str, tuple[str, Column]],
    *,
    backward: Mapping[str, tuple[str, Column]] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Add the running ``max``, ``min`` or ``sum`` of each state up to its row.

    ``states`` maps a new column to (kind, expression); those of ``backward`` run from the last
    row to the first. Rows of ``order`` are unique per key. The input is read once: its rows with the states
    inside their ranges are written, the ends of the ranges are carried from there, and only
    keys with rows beyond the lowest range can have something to add.
    """
    keys, after = list(keys), dict(backward or {})
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    every = {**states, **after}
    local = Window.partitionBy(*keys, "_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = local.orderBy(F.col(order).asc()), local.orderBy(F.col(order).desc())
    here = {n: _REDUCE[kind](expr).over(down if n in after else up) for n, (kind, expr) in every.items()}
    staged = cut(ranged.select(*df.columns, "_range", *[c.alias(f"_l_{n}") for n, c in here.items()]))

    low, high = staged.agg(F.min("_range"), F.max("_range")).first()
    if low == high:
        none = lambda n: F.lit(None).cast(staged.schema[f"_l_{n}"].dataType)
        return staged.select(*df.columns, *[_merge(kind, none(n), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in every.items()])

    def end(name: str, kind: str) -> Column:
        """The state of a whole range: that of the row that is reached last."""
        if kind != "sum":
            return _REDUCE[kind](f"_l_{name}")
        return (F.min_by if name in after else F.max_by)(f"_l_{name}", order)

    beyond = staged.where(F.col("_range") > low).select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    wide = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    spans = staged.join(beyond, wide, "left_semi").groupBy(*keys, "_range").agg(*[end(n, kind).alias(f"_s_{n}") for n, (kind, _) in every.items()])
    before = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first, last = before.orderBy(F.col("_range").asc()), before.orderBy(F.col("_range").desc())
    carried = spans.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_many > 1").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        *[_REDUCE[kind](f"_s_{n}").over(last if n in after else first).alias(f"_c_{n}") for n, (kind, _) in every.items()],
    )
    same = F.col("_range") == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = staged.join(cut(carried), same, "left")
    return out.select(
        *df.columns, *[_merge(kind, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (kind, _) in every.items()]
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    ranges: Sequence[Sequence[Column]],
    name: str,
    *,
    small: int | None = None,
) -> DataFrame:
    """Dense 0-based numbers per key, in ``order``.

    ``ranges`` lists, from coarse to fine, expressions that grow with ``order``;
    each level only has to be numbered inside the one above it, so neither the
    rows nor the range counts of one key meet in a single task. Where most keys have few rows,
    ``small`` says up to how many are numbered as they are; only larger keys are cut into ranges.
    """
    keys = list(keys)
    if small is not None:
        large = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > small).select(*keys))
        whole = lambda rows: rows.withColumn(
            name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
        )
        if large.isEmpty():
            return whole(df)
        ranged = number_rows(df.join(large, keys, "left_semi"), keys, order, ranges, name)
        return whole(df.join(large, keys, "left_anti")).select(*df.columns, name).unionByName(ranged)
    levels: list[list[str]] = []
    ranged = df
    for i, exprs in enumerate(ranges):
        cols = []
        for j, expr in enumerate(exprs):
            col = f"_r{i}_{j}"
            ranged = ranged.withColumn(col, expr)
            cols.append(col)
        levels.append(cols)
    every = [c for cols in levels for c in cols]
    counts = ranged.groupBy(*keys, *every).agg(F.count(F.lit(1)).alias("_n"))
    starts = None
    for i, cols in enumerate(levels):
        above = [c for upper in levels[:i] for c in upper]
        level = counts.groupBy(*keys, *above, *cols).agg(F.sum("_n").alias("_n"))
        before = (
            Window.partitionBy(*keys, *above)
            .orderBy(*cols)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = level.select(
            *keys, *above, *cols, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_b{i}")
        )
        starts = level if starts is None else starts.join(level, [*keys, *above])
    base = sum((F.col(f"_b{i}") for i in range(1, len(levels))), F.col("_b0"))
    inside = Window.partitionBy(*keys, *every).orderBy(*order)
    return (
        ranged.join(starts.select(*keys, *every, base.alias("_base")), [*keys, *every])
        .withColumn(name, (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
        .select(*df.columns, name)
    )


def joined_text(
    df: DataFrame, keys: Sequence[str], order: str, text: str, sep: str, name: str,
    *, width: int = 4096,
) -> DataFrame:
    """One text per key from ordered pieces, first joined inside order ranges."""
    keys = list(keys)

    def fold(frame: DataFrame, by: Sequence[str], at: str, piece: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(at), F.col(piece))))
        return frame.groupBy(*by).agg(
            F.array_join(F.transform(ordered, lambda s: s[piece]), sep).alias("_part")
        )

    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    parts = fold(ranged, [*keys, "_range"], order, text)
    return fold(parts, keys, "_range", "_part").withColumnRenamed("_part", name)
