"""Product codes against plain integer arithmetic, and bounds that prune without changing a result."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import laesa


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, label, vector) -> {row number: (code, error, label_error)}, digest; all distances, Python integers."""
    good = [(i, r) for i, r in enumerate(rows) if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = parts * -(-max((len(r[2]) for _, r in good), default=0) // parts)
    w = width // parts
    whole = {i: [math.floor(4096 * x) for x in r[2]] + [0] * (width - len(r[2])) for i, r in good}
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = sorted(good, key=lambda g: (g[1][0] is None, g[1][0] or 0, g[1][2]))[:entries]
    books = [[cut(whole[i])[p] for i, _ in first] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for i, _r in good:
                x = cut(whole[i])[p]
                held.setdefault(nearest(x, books[p])[0], []).append(x)
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e], strict=True)] if e in held else old for e, old in enumerate(books[p])]
    out, by_label = {}, {}
    for i, r in good:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(whole[i]))]
        out[i] = ("".join(f"{e:02x}" for e, _ in found), min(sum(d for _, d in found), 2**63 - 1))
        by_label[r[1]] = by_label.get(r[1], 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(rows[i][0]), str(rows[i][1]), *out[i], min(by_label[rows[i][1]], 2**63 - 1), digest) for i in out)


def got(spark, rows, kind="float"):
    df = spark.createDataFrame(
        [(*r, 1, "x", b"p") for r in rows], f"vec_id long, label string, embedding array<{kind}>, same int, codes string, parts binary"
    ).repartition(3)
    out, books = laesa.coded(df)
    result = laesa.vector_codes(df)
    assert result.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    labels = {(r.vec_id, bytes(r.codes).hex(), r.error): r.label for r in out.collect()}
    return sorted((str(r.vec_id), str(labels[r.vec_id, r.code, r.error]), r.code, r.error, r.label_error, r.codebooks_sha256) for r in result.collect())


def some(rng, n, dims, spread=1.0):
    f = lambda: float(np.float32(rng.gauss(0, spread)))
    return [(i, rng.choice(["a", "b", None]), [f() for _ in range(dims)]) for i in range(n)]


def test_codes_are_those_of_plain_arithmetic(spark):
    rng = random.Random(5)
    rows = some(rng, 150, 24)
    rows += [(1000, "a", None), (1001, None, [None] + [0.5] * 23), (1002, "a", [math.nan] * 24), (1003, "b", [math.inf] + [0.0] * 23)]
    rows += [(7, "b", [0.25] * 24), (7, "b", [0.25] * 24), (None, "a", [0.5] * 24), (-5, None, [0.0] * 24), (1004, "b", [1.0] * 5), (1005, "b", [])]
    assert got(spark, rows) == plain(rows)


def test_ties_few_rows_and_sizes(spark):
    same = [(i, "a", [1.0, -1.0] * 8) for i in range(40)]
    assert got(spark, same) == plain(same)
    ladder = [(i, None, [float(i % 5)] * 16) for i in range(60)]
    assert got(spark, ladder) == plain(ladder)
    few = some(random.Random(1), 3, 11)
    assert got(spark, few) == plain(few)
    assert got(spark, [(1, "a", []), (2, "a", [])]) == plain([(1, "a", []), (2, "a", [])])


def test_very_large_components_are_exact(spark):
    rng = random.Random(9)
    rows = [*some(rng, 40, 16, 1e4), *[(100 + i, "z", v) for i, (_, _, v) in enumerate(some(rng, 20, 16, 1e30))]]
    want = plain(rows)
    assert got(spark, rows, "double") == want and any(w[3] == 2**63 - 1 for w in want)


def test_empty_and_nothing_kept(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert laesa.vector_codes(df).collect() == []
    bad = spark.createDataFrame([(1, 2, None), (2, 2, [math.nan])], "vec_id long, label int, embedding array<float>")
    assert laesa.vector_codes(bad).collect() == []


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    pivots = laesa.pivots_of(centres, 4)
    far = laesa.roots(laesa.squared(x[:, None], pivots[None])).astype(np.float32)
    chosen, best, tried = laesa.nearest(x, far, centres, pivots)
    d = laesa.squared(x[:, None], centres[None])
    assert (chosen == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert tried < 2 * len(x)  # of 16 a row


def test_labels_of_any_kind(spark):
    rows = [(i, [float(i)] * 8, 0.5 if i % 2 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "n long, v array<double>, kind double")
    out = laesa.vector_codes(df, vector="v", vec_id="n", label="kind")
    sums = {r[0]: r[1] for r in out.groupBy("vec_id").agg(F.max("label_error")).collect()}
    assert len(sums) == 20 and len(set(sums.values())) <= 2
