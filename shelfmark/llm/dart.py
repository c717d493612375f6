"""Near-duplicates by weighted DartMinHash signatures, banded joins and exact checks.

A document is the weighted set of its word shingles, the weight being how often each occurs.
Darts fall on the plane of weight and rank of every shingle as a Poisson process that is a
fixed function of the shingle's hash. The plane is cut into regions of doubling weight, and a
shingle throws the darts of the regions that its weight reaches, in order of rank, up to a
rank at which the document has enough of them to hit every coordinate; it keeps the darts
below its weight. A dart's hash names a coordinate, and a coordinate keeps its earliest dart.
Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.

1. Equal texts become one node before anything is joined.
2. Signatures are cut into bands; nodes that share a band share a bucket. A bucket pairs its
   members with two leaders only, chosen by a hash that differs by bucket.
3. Pairs are checked exactly on their shingles: first the most alike partner of every node,
   then what is left between the classes that makes. Links are joined to classes.
4. Buckets whose other members still belong to different classes are compared between
   classes, in tiles of bounded size, on packed signatures and then exactly. So no link between
   texts that share a bucket is lost, and groups of near copies collapse before they are
   compared.

Keys that many rows share (a large bucket, a leader, the text of many copies) meet small sides
in sort-merge joins, whose large partitions Spark splits at run time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import bytes_of, split_by_bytes, squeeze, unsqueeze
from shelfmark.llm.components import components
from shelfmark.llm.words import Words, mix
from shelfmark.session import cut

SHINGLE = 5
LEAST = 0.8
BANDS = 30
BAND_ROWS = 5
COORDINATES = BANDS * BAND_ROWS
SLICE_BYTES = 1 << 19
SLICE_ROWS = 512
TILE = 256
#: Two texts of similarity ``LEAST`` agree in fewer coordinates with a chance of about one in 100,000.
MAYBE = 0.66
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_BITS = np.uint64(32)


def weighted_shingles(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, number of occurrences), each shingle of a text once, in order."""
    hashes, text = Words(texts).shingles(size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], hashes[at], np.diff(np.append(at, len(hashes)))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and below 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def darts(hashes: np.ndarray, weights: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(element, rank, hash) of all darts of the elements below their weight and rank ``top``.

    Region 0 of an element has weights 0 to 1, region r those from ``2**(r - 1)`` to ``2**r``.
    """
    regions = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1
    element = np.repeat(np.arange(len(hashes)), regions)
    region = np.arange(len(element)) - np.repeat(np.cumsum(regions) - regions, regions)
    width = np.where(region == 0, 1.0, 2.0 ** (region - 1))
    base = np.where(region == 0, 0.0, width)
    seed = mix(hashes[element] + region.astype(np.uint64) * GOLDEN, 1)
    rank = np.zeros(len(element))
    first, many = 0, 1
    while len(element):
        ids = mix(seed[:, None] + (first + np.arange(many)).astype(np.uint64) * GOLDEN, 2)
        ranks = rank[:, None] + np.cumsum(-np.log(unit(ids)) / width[:, None], axis=1)
        inside = ranks < top[element][:, None]
        kept = inside & (base[:, None] + width[:, None] * unit(mix(ids, 3)) < weights[element][:, None])
        row, col = np.nonzero(kept)
        yield element[row], ranks[row, col], ids[row, col]
        on = inside[:, -1]
        element, seed, width, base, rank = element[on], seed[on], width[on], base[on], ranks[on, -1]
        first, many = first + many, min(2 * many, 64)


def dart_signatures(n: int, text: np.ndarray, hashes: np.ndarray, weights: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The hash of the dart that each coordinate of each text keeps; zeros for a text without shingles."""
    out = np.zeros((n, size), np.uint64)
    weights = weights.astype(np.float64)
    total = np.bincount(text, weights, minlength=n)
    want = size * (np.log(size) + 4)
    left = total > 0
    while left.any():
        top = np.where(left, want / np.maximum(total, 1), 0.0)
        live = np.flatnonzero(left[text])
        best = np.full(n * size, np.inf)
        keep = np.zeros(n * size, np.uint64)
        for element, rank, ids in darts(hashes[live], weights[live], top[text[live]]):
            cell = text[live[element]] * size + (mix(ids, 4) % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            won = best[cell] == rank
            keep[cell[won]] = ids[won]
        done = left & np.isfinite(best.reshape(n, size)).all(1)
        out[done] = keep.reshape(n, size)[done]
        left &= ~done
        want *= 2
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = mix(signature, 5).reshape(len(signature), BANDS, BAND_ROWS)
    odd = (2 * np.arange(BAND_ROWS) + 1).astype(np.uint64) * GOLDEN
    return mix((parts * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 6)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, low): node is the MD5 of the text, ``low`` has one byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch, "text", SLICE_BYTES, SLICE_ROWS):
                texts = bytes_of(part.column("text"))
                signature = dart_signatures(len(texts), *weighted_shingles(texts))
                some = signature.any(axis=1)
                bands, low = buckets(signature), mix(signature, 7).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([hashlib.md5(t or b"").digest() for t in texts], pa.binary()),
                        pa.array([b.tobytes() if s else b"" for b, s in zip(bands, some, strict=True)], pa.binary()),
                        pa.array([b.tobytes() for b in low], pa.binary()),
                    ],
                    names=["doc_id", "node", "bands", "low"],
                )

    return docs.mapInArrow(run, "doc_id long, node binary, bands binary, low binary")


def band_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, node, h): a row for each band; ``h`` orders the members of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                raw = b"".join(part.column("bands").to_pylist())
                bands = np.frombuffer(raw, np.int64)
                node = part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(bands), node], names=["bucket", "node"])

    rows = nodes.where("length(bands) > 0").select("node", "bands").mapInArrow(run, "bucket long, node binary")
    return rows.withColumn("h", F.xxhash64("bucket", "node"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, low_a, low_b) with the share of agreeing coordinates, if it may be enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("low_a", "low_b"))
            share = (a == b).mean(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"])
            yield out.filter(pa.array(share >= MAYBE))

    return pairs.mapInArrow(run, "a binary, b binary, share double")


def shingle_sets(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, body) of the nodes in ``firsts`` (node, doc_id), from one document of each."""
    own = docs.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    one = own.join(firsts.withColumnRenamed("node", "wanted"), own["doc_id"].eqNullSafe(firsts["doc_id"])).where("node = wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch, "text", SLICE_BYTES):
                text, hashes, weights = weighted_shingles(bytes_of(part.column("text")))
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                hashes = hashes >> (np.uint64(64) - SHINGLE_BITS)
                body = [squeeze(hashes[a:b], weights[a:b].astype(np.uint32)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(body, pa.binary())], names=["node", "body"])

    sets = one.select("node", "text").mapInArrow(run, "node binary, body binary")
    return sets.groupBy("node").agg(F.first("body").alias("body"))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is ``least`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    right = sets.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist()
            near = [similarity(tuple(unsqueeze(p)), tuple(unsqueeze(q))) >= least for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a binary, b binary")


def tiles(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different roots in a bucket; ``rows`` is (bucket, n, h, node, root, low, body).

    A bucket is cut into parts of ``TILE`` members, and every two parts meet in one tile. A tile
    compares members of different classes: by signature, then exactly. What it has linked it
    counts as one class, so it emits fewer links than it has members.
    """
    parts = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumns({"parts": parts, "own": F.pmod("h", parts).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select("bucket", "i", "j", "own", "node", "root", "low", "body")
    shuffled = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compared(part: pa.Table) -> pa.RecordBatch:
        own, i, j = (part.column(c).to_numpy() for c in ("own", "i", "j"))
        low = np.frombuffer(b"".join(part.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        node, root = part.column("node").to_pylist(), part.column("root").to_pylist()
        names = {r: k for k, r in enumerate(sorted(set(root)))}
        cls = np.array([names[r] for r in root])
        body, sets, out = part.column("body").to_pylist(), {}, []

        def shingles(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in sets:
                sets[k] = tuple(unsqueeze(body[k]))
            return sets[k]

        for x in np.flatnonzero(own == i):
            ys = np.arange(x + 1, len(own)) if i[0] == j[0] else np.flatnonzero(own == j)
            ys = ys[cls[ys] != cls[x]]
            ys = ys[(low[ys] == low[x]).mean(axis=1) >= MAYBE] if len(ys) else ys
            for y in ys.tolist():
                if cls[y] != cls[x] and similarity(shingles(int(x)), shingles(y)) >= least:
                    out.append(tuple(sorted((node[x], node[y]))))
                    cls[cls == cls[y]] = cls[x]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("bucket", "i", "j")]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(at[:-1], at[1:], strict=True):
                k = tuple(int(c[a]) for c in columns)
                if held and k != key:
                    yield compared(pa.Table.from_batches(held))
                    held = []
                key = k
                held.append(batch.slice(a, b - a))
        if held:
            yield compared(pa.Table.from_batches(held))

    return shuffled.mapInArrow(run, "a binary, b binary")


def with_roots(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """``df`` with the class of ``node``; a node without links is its own."""
    named = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return df.join(named, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def key_of(doc_id: str) -> Column:
    """Ids in order, nulls last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def near_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(doc_id, node, class_id, first): a row per row of ``docs``.

    Texts are linked if the weighted Jaccard similarity of their five-word shingles (weight:
    number of occurrences) is ``least`` or more, and equal texts always; a class is a component
    of links, and ``class_id`` its least id (null only if all its ids are). A text of one to
    four words is one shingle; texts without words are alike only if equal, null counting as
    empty. ``first`` is true for rows with the least id and, among texts of that id, the least
    node: one for each class, but for repeated rows, which are equal. Nulls come last. The
    candidate bands miss a link of similarity 0.8 with a chance of 7 in a million.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut(signed(docs))
    nodes = cut(
        rows.groupBy("node").agg(
            F.min(key_of("doc_id")).alias("k"), F.first("bands").alias("bands"), F.first("low").alias("low")
        ).select("node", F.col("k.id").alias("doc_id"), "bands", "low")
    )
    bands = band_rows(nodes)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("h").alias("low_h"), F.max("h").alias("high_h")).where("n > 1")
    members = cut(bands.join(shared, "bucket").join(nodes.select("node", "low"), "node"))
    lead = (F.col("h") == F.col("low_h")) | (F.col("h") == F.col("high_h"))
    leaders = members.where(lead).select("bucket", F.col("node").alias("leader"), F.col("low").alias("leader_low"))
    pairs = (
        members.select("bucket", "node", "low").join(leaders, "bucket").where("node != leader")
        .select(
            F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"),
            F.when(F.col("node") < F.col("leader"), F.col("low")).otherwise(F.col("leader_low")).alias("low_a"),
            F.when(F.col("node") < F.col("leader"), F.col("leader_low")).otherwise(F.col("low")).alias("low_b"),
        )
    )
    pairs = cut(agreement(pairs).distinct())
    used = members.select("node").distinct()
    sets = cut(shingle_sets(docs, nodes.select("node", "doc_id").join(used, "node", "left_semi")))
    sides = pairs.select(F.col("a").alias("node"), "a", "b", "share").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "share"))
    closest = sides.groupBy("node").agg(F.max(F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    links = cut(linked(closest, sets, least))
    roots = components(links)
    open_pairs = with_roots(with_roots(pairs, roots, "a", "root_a"), roots, "b", "root_b").where("root_a != root_b").select("a", "b")
    links = cut(links.unionByName(linked(open_pairs.join(closest, ["a", "b"], "left_anti"), sets, least)))
    roots = components(links)
    others = cut(with_roots(members.where(~lead), roots, "node", "root"))
    mixed = others.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("bucket")
    rest = others.join(mixed, "bucket").join(sets, "node")
    between = tiles(rest.select("bucket", "n", "h", "node", "root", "low", "body"), least)
    roots = components(links.unionByName(between))
    classed = with_roots(nodes.select("node", "doc_id"), roots, "node", "root")
    best = classed.groupBy("root").agg(F.min(F.struct(key_of("doc_id"), "node")).alias("best"))
    named = classed.select("node", "root").join(best, "root").select(
        "node", F.col("best.col1.id").alias("class_id"), F.col("best.node").alias("best_node")
    )
    return rows.select("doc_id", "node").join(named, "node").select(
        "doc_id", "node", "class_id",
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("best_node"))).alias("first"),
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each class (see ``near_classes``), all its columns as they were."""
    firsts = near_classes(docs, text, doc_id, least).where("first").select(F.col("doc_id").alias("first_id"), "node").distinct()
    # The rows travel as one column, so no name of theirs can meet one of ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    rows = docs.select(row.alias("row"), F.col(doc_id).cast("long").alias("id"), own.alias("own"))
    kept = rows.join(firsts, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("own") == F.col("node")), "left_semi")
    return kept.dropDuplicates(["id", "own"]).select("row.*")
