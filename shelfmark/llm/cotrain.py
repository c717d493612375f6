"""Quality classifier by co-training of a text view and a metadata view.

A document is good if its label says quality 1 and not toxic. Two logistic models look at
one document each in its own way: the text view at the words it has and at its shape, the
metadata view at language, source and length. They are fitted on a bounded sample of labelled
rows; then, for ``ROUNDS`` rounds, each labels the unlabelled documents of a bounded pool it
is most certain of for the other one, and both are fitted again. Labelled rows that were kept
apart calibrate each view (a view without a signal calibrates to the base rate), the sum of
the calibrated log-odds scores every document, and the same rows give the threshold.

The fit sees at most ``SAMPLE`` labelled and ``POOL`` unlabelled rows, taken by the hash of
their ids, so its cost doesn't follow the corpus. Scoring is one pass over all whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import bytes_of, split_by_bytes, squeeze, unsqueeze
from shelfmark.llm.words import Words

SAMPLE = 8000
POOL = 3000
ROUNDS = 3
CERTAIN = 0.95
MOST = 400
PSEUDO_WEIGHT = 0.5
WORD_BITS = 16
META_BITS = 12
LEAST_CHI = 20.0
SLICE_BYTES = 1 << 21
SHAPES = 10
DECAY = 1e-5
#: Classes of bytes: 1 capitals, 2 small letters, 3 digits, 4 ends and commas, 5 other ASCII signs, 6 line ends, 7 not ASCII.
KIND = np.zeros(256, np.int64)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 7
KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
KIND[[ord(c) for c in ".,;:'\"-()"]] = 4
KIND[[10, 13]] = 6


class Rows:
    """Sparse rows with ones: feature numbers of row r are ``index[first[r]:first[r + 1]]``, and dense columns."""

    def __init__(self, index: np.ndarray, first: np.ndarray, dense: np.ndarray) -> None:
        self.index, self.first, self.dense = index, first, dense
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def __len__(self) -> int:
        return len(self.first) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.first)[rows]
        first = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.first[:-1][rows] - first[:-1], sizes) + np.arange(first[-1])
        return Rows(self.index[at], first, self.dense[rows])


def text_rows(texts: list[bytes | None]) -> Rows:
    """Distinct words (hashed, without case) and shape of texts."""
    words = Words(texts, lower=True)
    n = len(texts)
    doc = np.repeat(np.arange(n), words.counts)
    key = np.unique(doc.astype(np.uint64) << np.uint64(WORD_BITS) | words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    first = np.searchsorted(key, np.arange(n + 1) << WORD_BITS)
    raw = np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)
    sizes = np.array([len(t or b"") for t in texts])
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * 8 + KIND[raw], minlength=n * 8).reshape(n, 8)
    share = kinds / np.maximum(sizes, 1)[:, None]
    rest = [np.log1p(words.counts), np.diff(first) / np.maximum(words.counts, 1)]
    return Rows(key & ((1 << WORD_BITS) - 1), first, np.column_stack([share, *rest]))


def meta_rows(lang: list, source: list, chars: list) -> Rows:
    """Language, source and length class of documents, and language with length class."""
    out = []
    for a, b, n in zip(lang, source, chars, strict=True):
        size = -1 if n is None else int(n).bit_length()
        names = (f"l={a}", f"s={b}", f"n={size}", f"l={a} n={size}")
        out.append([zlib.crc32(x.encode()) >> (32 - META_BITS) for x in names])
    return Rows(np.array(out, np.int64).reshape(-1), np.arange(len(out) + 1) * 4, np.zeros((len(out), 0)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def shaped(dense: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Dense columns in standard units, cut at 2.5: no shape alone is stranger than those in the sample."""
    return np.clip((dense - center) / scale, -2.5, 2.5)


@dataclass
class View:
    """A logistic model with its calibration ``a * z + b``."""

    weight: np.ndarray
    dense: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def raw(self, rows: Rows) -> np.ndarray:
        z = np.bincount(rows.row, self.weight[rows.index], minlength=len(rows)) if len(rows.index) else np.zeros(len(rows))
        return z + shaped(rows.dense, self.center, self.scale) @ self.dense + self.bias

    def logit(self, rows: Rows) -> np.ndarray:
        return self.a * self.raw(rows) + self.b


def fitted(rows: Rows, good: np.ndarray, weight: np.ndarray, bits: int, least_chi: float, steps: int = 300) -> View:
    """Logistic regression by Adam over all rows, on the features that a chi-square test ties to the labels."""
    size = 1 << bits
    df = np.bincount(rows.index, minlength=size)
    bad = np.bincount(rows.index[~good[rows.row]], minlength=size)
    share = (~good).mean()
    chi = (bad - df * share) ** 2 / np.maximum(df * share * (1 - share), 1e-9)
    used = np.flatnonzero((chi >= least_chi) & (df > 1))
    new = np.full(size, -1)
    new[used] = np.arange(len(used))
    keep = new[rows.index] >= 0
    index, row = new[rows.index[keep]], rows.row[keep]
    center, scale = rows.dense.mean(0), rows.dense.std(0) + 1e-6
    dense = shaped(rows.dense, center, scale)
    balance = np.where(good, weight.sum() / 2 / max(weight[good].sum(), 1e-9), weight.sum() / 2 / max(weight[~good].sum(), 1e-9))
    w = weight * balance / weight.sum()
    k = len(used)
    theta, m, v = np.zeros(k + dense.shape[1] + 1), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[index], minlength=len(rows)) + dense @ theta[k:-1] + theta[-1]
        g = w * (sigmoid(z) - good)
        grad = np.concatenate([np.bincount(index, g[row], minlength=k), dense.T @ g, [g.sum()]]) + DECAY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    full = np.zeros(size)
    full[used] = theta[:k]
    return View(full, theta[k:-1], center, scale, float(theta[-1]))


def calibrated(view: View, rows: Rows, good: np.ndarray) -> None:
    """Platt scaling with smoothed targets, by Newton's method."""
    z = view.raw(rows)
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = z.std() + 1e-9
    x = np.column_stack([z / scale, np.ones(len(z))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ theta)
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * theta * [1, 0])
    view.a, view.b = max(theta[0], 0.0) / scale, theta[1]


@dataclass
class Model:
    text: View
    meta: View
    prior: float
    threshold: float

    def logits(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of the views and of both together."""
        t, m = self.text.logit(text), self.meta.logit(meta)
        return t, m, t + m - self.prior


def joined(parts: list[tuple]) -> tuple[Rows, Rows]:
    """Rows of both views from rows of (features, shape, lang, source, n_chars)."""
    index = [unsqueeze(p[0])[0].astype(np.int64) for p in parts]
    first = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64)
    text = Rows(np.concatenate(index), first, np.array([p[1] for p in parts]).reshape(-1, SHAPES))
    return text, meta_rows([p[2] for p in parts], [p[3] for p in parts], [p[4] for p in parts])


def features(docs: DataFrame) -> list:
    """Features of a bounded set of documents, in order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_by_bytes(batch, "text", SLICE_BYTES):
                rows = text_rows(bytes_of(part.column("text")))
                cuts = [rows.index[a:b] for a, b in zip(rows.first[:-1], rows.first[1:], strict=True)]
                part = part.append_column("features", pa.array([squeeze(c.astype(np.uint32)) for c in cuts], pa.binary()))
                part = part.append_column("shape", pa.array(list(rows.dense), pa.list_(pa.float64())))
                yield part.select(["doc_id", "good", "features", "shape", "lang", "source", "n_chars"])

    schema = "doc_id long, good int, features binary, shape array<double>, lang string, source string, n_chars long"
    return sorted(docs.mapInArrow(run, schema).collect(), key=lambda r: (r[0], r[2]))


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns both views use; those that a table lacks are null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def weighed(z: np.ndarray, good: np.ndarray) -> float:
    """The log-odds from which rows are kept, so that lost good and missed bad rows are fewest; of equals the nearest to even odds."""
    order = np.argsort(z, kind="stable")
    at = np.concatenate([[0.0], z[order], np.nextafter(z[order[-1:]], np.inf)])
    first = np.searchsorted(z[order], at)
    lost = np.concatenate([[0], np.cumsum(good[order])])[first]
    missed = (~good).sum() - np.concatenate([[0], np.cumsum(~good[order])])[first]
    return float(at[np.lexsort((np.abs(at), lost + missed))[0]])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL, rounds: int = ROUNDS) -> Model | None:
    """The model, or None without labelled good and bad documents to learn from (both at least twice)."""
    docs = columns_of(docs)
    order = F.xxhash64("doc_id", F.lit(11))
    known = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    )
    # At most ``sample + pool`` ids are broadcast.
    chosen = known.orderBy(order, "doc_id").limit(sample)
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    others = ids.join(known, "doc_id", "left_anti").orderBy(order, "doc_id").limit(pool)
    wanted = chosen.unionByName(others.withColumn("good", F.lit(-1)))
    got = features(docs.join(F.broadcast(wanted), "doc_id"))
    got = [r for i, r in enumerate(got) if i == 0 or r[0] != got[i - 1][0]]  # one row an id
    good = np.array([r[1] for r in got], np.int64)
    fold = np.array([zlib.crc32(str(r[0]).encode()) % 4 == 3 for r in got], bool)
    held = (good >= 0) & fold
    if min(*(((good == g) & (fold == f)).sum() for g in (0, 1) for f in (False, True))) < 1:
        return None
    text, meta = joined([tuple(r)[2:] for r in got])
    views = [(text, WORD_BITS, LEAST_CHI), (meta, META_BITS, 0.0)]
    fit, free = np.flatnonzero((good >= 0) & ~fold), np.flatnonzero(good < 0)
    sets = [(fit, good[fit] == 1, np.ones(len(fit))) for _ in views]
    models: list[View] = []
    for turn in range(rounds + 1):
        models = [fitted(rows.take(s[0]), s[1], s[2], bits, chi) for (rows, bits, chi), s in zip(views, sets, strict=True)]
        for m, (rows, _, _) in zip(models, views, strict=True):
            calibrated(m, rows.take(np.flatnonzero(held)), good[held] == 1)
        if turn == rounds or not len(free):
            break
        sure = []
        for m, (rows, _, _) in zip(models, views, strict=True):
            p = sigmoid(m.logit(rows.take(free)))
            best = [np.argsort(q, kind="stable")[:MOST] for q in (-p, p)]
            sure.append(([b[q[b] >= CERTAIN] for b, q in zip(best, (p, 1 - p), strict=True)]))
        for v, (yes, no) in enumerate(reversed(sure)):  # each view learns from the other one's
            rows = np.concatenate([fit, free[yes], free[no]])
            said = np.concatenate([good[fit] == 1, np.ones(len(yes), bool), np.zeros(len(no), bool)])
            sets[v] = (rows, said, np.concatenate([np.ones(len(fit)), np.full(len(yes) + len(no), PSEUDO_WEIGHT)]))
    n1, n0 = (good[held] == 1).sum(), (good[held] == 0).sum()
    model = Model(*models, prior=float(np.log((n1 + 1) / (n0 + 1))), threshold=0.5)
    at = np.flatnonzero(held)
    z = model.logits(text.take(at), meta.take(at))[2]
    model.threshold = float(sigmoid(np.array([weighed(z, good[at] == 1)]))[0])
    return model


def scored(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` with ``p_text``, ``p_meta``, ``p_good`` and ``keep``; other columns as they were.

    ``keep`` is whether ``p_good`` reaches the threshold by which the fewest held-out rows are
    wrong, lost good and missed bad ones alike. Null and empty texts are texts without words; null or missing metadata
    columns are a value of their own. An id labelled twice is bad if one of its labels says so;
    null labels and ids teach nothing. Without labels to learn from every probability is null
    and every document is kept. Columns named like the four new ones are replaced.
    """
    docs = docs.drop("p_text", "p_meta", "p_good", "keep")
    model = trained(docs, labels, **bounds)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"p_text": none, "p_meta": none, "p_good": none, "keep": F.lit(True)})
    names = docs.columns
    parts = model.text, model.meta, model.prior, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model(*parts)
        for batch in batches:
            for part in split_by_bytes(batch, "text", SLICE_BYTES):
                get = lambda c, p=part: p.column(c).to_pylist() if c in names else [None] * p.num_rows
                text, meta = text_rows(bytes_of(part.column("text"))), meta_rows(get("lang"), get("source"), get("n_chars"))
                views = [sigmoid(z) for z in held.logits(text, meta)]
                for name, p in zip(("p_text", "p_meta", "p_good"), views, strict=True):
                    part = part.append_column(name, pa.array(p))
                yield part.append_column("keep", pa.array(views[2] >= held.threshold))

    zero = F.lit(0.0)
    schema = docs.withColumns({"p_text": zero, "p_meta": zero, "p_good": zero, "keep": F.lit(True)}).schema
    return docs.mapInArrow(run, schema)
