"""A gated recurrent language model, fitted and applied block by block.

Words are counted over all training documents: every block of documents sends the distinct
words it has, with their training counts, to segments of the hash space; a segment answers
each block with the corpus counts. The most frequent ``CLASSES * CLASS_WORDS - 1`` words are
the vocabulary of the network; any other word is written by its tail sign and then by its
share of the corpus counts of tail words.

The network is a GRU whose softmax is factored into a class and a word in the class, classes
being ranks of frequency. It is fitted by truncated backpropagation in numpy: in each round
every block starts from the same weights and learns from the next part of its training tokens,
so that after the last round each token has been learned from; the weights are averaged by
tokens in two steps of bounded size. All documents are scored whole: windows of a batch of
documents follow each other and carry the state.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.blocks import (
    answered, asked, bytes_of, cuts, packed, squeeze, total_words, unsqueeze, with_answers,
)
from shelfmark.llm.words import Words, mix
from shelfmark.session import cut

CLASSES = 32
CLASS_WORDS = 64
UNITS = 16
ROUNDS = 3
#: Streams of a part: as many as leave it about so many updates, within bounds.
UPDATES = 128
STREAMS = 16, 256
STEP = 16
WINDOW = 64
#: Windows are longer where few documents go on, so that each holds about so many tokens.
WINDOW_TOKENS = 1 << 15
RATE = 0.2
BLOCK_BYTES = 8 << 20
SEGMENT_WORDS = 1 << 20
#: The hash of the sign after every text.
END = np.uint64(0x5851F42D4C957F2D)
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


class Tokens:
    """Token hashes of a block of documents, each text ending with the end sign."""

    def __init__(self, table: pa.Table, text: str, doc_id: str, held_out) -> None:
        words = Words(bytes_of(table.column(text)), lower=True)
        n = len(words.counts)
        self.first = words.first + np.arange(n + 1)
        self.hash = np.empty(len(words.hash) + n, np.uint64)
        ends = np.zeros(len(self.hash), bool)
        ends[self.first[1:] - 1] = True
        self.hash[ends], self.hash[~ends] = END, words.hash
        self.ids = table.column(doc_id).to_pylist()
        self.held_out = np.array([held_out(i) for i in self.ids], bool)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes in order, their training counts, and where each token's hash stands among them."""
        known, where = np.unique(self.hash, return_inverse=True)
        count = np.bincount(where[~self.held_out[self.doc]], minlength=len(known))
        return known, count, where

    def training(self) -> np.ndarray:
        """All tokens of the training documents, in an order of documents by hash."""
        order = [d for d in np.argsort(mix(self.first[:-1].astype(np.uint64), 9)) if not self.held_out[d]]
        return np.concatenate([np.zeros(0, np.uint64), *[self.hash[self.first[d] : self.first[d + 1]] for d in order]])


def parts_of(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts of a token sequence, each with the sign before it: every token has its turn as a target."""
    full = np.concatenate([[CLASSES * CLASS_WORDS], numbers]).astype(np.uint16 if CLASSES * CLASS_WORDS < 2**16 else np.uint32)
    at = len(numbers) * np.arange(parts + 1) // parts
    return [full[a : b + 1] for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def streams_of(part: np.ndarray) -> np.ndarray:
    """A part as rows of equal length; neighbours share the sign before, and a few tokens where the length doesn't divide."""
    n = len(part) - 1
    streams = min(max(STREAMS[0], min(STREAMS[1], n // (STEP * UPDATES))), n)
    wide = -(-n // streams)
    begin = np.arange(streams) * (n - wide) // max(streams - 1, 1)
    return part[begin[:, None] + np.arange(wide + 1)].astype(np.int64)


def in_sample(doc_id: int | None) -> bool:
    """The rule of the contract: not learned from if the CRC-32 of the id as text leaves 2 modulo 7."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def sigmoid(x: np.ndarray) -> None:
    """The logistic function in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)


class Network:
    """The GRU with class-factored output; ``p`` holds its weights by name."""

    SHAPES = {
        "embed": (CLASSES * CLASS_WORDS + 1, UNITS), "input": (UNITS, 3 * UNITS), "state": (UNITS, 3 * UNITS), "gate": (3 * UNITS,),
        "class_w": (UNITS, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, UNITS, CLASS_WORDS), "word_b": (CLASSES, CLASS_WORDS),
    }

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small fixed weights, and biases by which the untrained network gives the unigram shares."""
        rng = np.random.default_rng(5)
        p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in cls.SHAPES.items()}
        share = (counts + 0.1).reshape(CLASSES, CLASS_WORDS)
        p["class_b"] = np.log(share.sum(1) / share.sum()).astype(np.float32)
        p["word_b"] = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)
        p["class_w"] *= np.float32(0.1)
        p["word_w"] *= np.float32(0.1)
        p["gate"] *= np.float32(0)
        return cls(p)

    @classmethod
    def flat(cls, vector: np.ndarray) -> Network:
        p, at = {}, 0
        for k, s in cls.SHAPES.items():
            p[k] = vector[at : at + math.prod(s)].reshape(s).astype(np.float32)
            at += math.prod(s)
        return cls(p)

    def with_tail(self, ratio: float, share: float) -> Network:
        """The tail sign made ``ratio`` times as likely, for the words that training has not met; ``share`` is its share of its class."""
        self.p["word_b"][-1, -1] += np.float32(math.log(ratio))
        self.p["class_b"][-1] += np.float32(math.log(1 - share + share * ratio))
        return self

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in self.SHAPES])

    def states(self, tokens: np.ndarray, h: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
        """States before each token's successor: ``tokens`` is (time, streams); also what backpropagation needs, if kept."""
        # Inside, units come before streams: gates are then whole rows, and each step works on long ones.
        x = np.ascontiguousarray((self.p["embed"] @ self.p["input"] + self.p["gate"])[tokens].transpose(0, 2, 1))
        u, h = np.ascontiguousarray(self.p["state"].T), np.ascontiguousarray(h.T)
        out, held = np.empty((len(tokens), *h.shape), np.float32), []
        for t in range(len(tokens)):
            hu = u @ h
            zr, c, uc = x[t, : 2 * UNITS], x[t, 2 * UNITS :], hu[2 * UNITS :]
            zr += hu[: 2 * UNITS]
            sigmoid(zr)
            c += zr[UNITS:] * uc
            np.tanh(c, out=c)
            if keep:
                held.append((h, zr, c, uc))
            move = c - h
            move *= zr[:UNITS]
            h = np.add(h, move, out=out[t])
        return out.transpose(0, 2, 1), held

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target word after its state."""
        order, at, cls, word = by_class(target)
        h = h[order]
        got = log_share(h @ self.p["class_w"] + self.p["class_b"], cls)
        for c in np.flatnonzero(np.diff(at)):
            rows = slice(at[c], at[c + 1])
            got[rows] += log_share(h[rows] @ self.p["word_w"][c] + self.p["word_b"][c], word[rows])
        out = np.empty(len(got))
        out[order] = got
        return out

    def learn(self, streams: np.ndarray, rate: float = RATE, step: int = STEP) -> None:
        """One pass of truncated backpropagation over (streams, time), with Adagrad."""
        seen = {k: np.full(v.shape, 1e-3, np.float32) for k, v in self.p.items()}
        h = np.zeros((len(streams), UNITS), np.float32)
        for a in range(0, streams.shape[1] - 1, step):
            x, y = streams[:, a : a + step].T, streams[:, a + 1 : a + step + 1].T
            x = x[: len(y)]
            states, held = self.states(x, h)
            grad = self.gradient(x, y, states, held)
            for k, g in grad.items():
                seen[k] += g * g
                self.p[k] = self.p[k] - np.float32(rate) * g / np.sqrt(seen[k])
            h = states[-1]

    def gradient(self, x: np.ndarray, y: np.ndarray, states: np.ndarray, held: list) -> dict[str, np.ndarray]:
        p, n = self.p, x.size
        g = {k: np.zeros_like(v) for k, v in p.items()}
        order, at, cls, word = by_class(y.reshape(-1))
        h = states.reshape(-1, UNITS)[order]
        d = surprise(h @ p["class_w"] + p["class_b"], cls, n)
        g["class_w"], g["class_b"] = h.T @ d, d.sum(0)
        back = d @ p["class_w"].T
        for c in np.flatnonzero(np.diff(at)):
            rows = slice(at[c], at[c + 1])
            d = surprise(h[rows] @ p["word_w"][c] + p["word_b"][c], word[rows], n)
            g["word_w"][c], g["word_b"][c] = h[rows].T @ d, d.sum(0)
            back[rows] += d @ p["word_w"][c].T
        dh = np.empty_like(back)
        dh[order] = back
        dh = np.ascontiguousarray(dh.reshape(states.shape).transpose(0, 2, 1))
        carry = np.zeros_like(dh[0])
        dx, du = np.empty((2, len(x), 3 * UNITS, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, zr, c, hu = held[t]
            z, r = zr[:UNITS], zr[UNITS:]
            carry += dh[t]
            dc = carry * z
            stay = 1 - z
            dx[t, :UNITS] = dc * (c - before) * stay
            dc *= 1 - c * c
            dx[t, UNITS : 2 * UNITS] = dc * hu * r * (1 - r)
            dx[t, 2 * UNITS :] = dc
            du[t, : 2 * UNITS] = dx[t, : 2 * UNITS]
            np.multiply(dc, r, out=du[t, 2 * UNITS :])
            carry *= stay
            carry += p["state"] @ du[t]
        for (before, *_), d in zip(held, du, strict=True):
            g["state"] += before @ d.T
        words, flat = x.reshape(-1), dx.transpose(0, 2, 1).reshape(-1, 3 * UNITS)
        g["input"], g["gate"] = p["embed"][words].T @ flat, flat.sum(0)
        by_word = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[by_word], prepend=-1))
        g["embed"][words[by_word[first]]] = np.add.reduceat((flat @ p["input"].T)[by_word], first)
        return g


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by the class of their target: the order, bounds of classes, class and word in it of the ordered rows."""
    cls = (target // CLASS_WORDS).astype(np.uint8 if CLASSES <= 256 else np.uint32)
    order = np.argsort(cls, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])
    return order, at, cls[order], (target % CLASS_WORDS)[order]


def tamed(x: np.ndarray) -> np.ndarray:
    """Rows shifted, where some are too large or small for ``exp``; the shares stay."""
    return x - x.max(axis=1, keepdims=True) if x.size and (x.max() > 60 or x.min() < -60) else x


def surprise(x: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Gradient of the mean of ``n`` negative log-shares by the values in rows; ``x`` is overwritten."""
    x = tamed(x)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    x *= (1 / (n * total))[:, None]
    x[np.arange(len(x)), chosen] -= np.float32(1 / n)
    return x


def log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the chosen value's share in each row; ``x`` is overwritten."""
    x = tamed(x)
    picked = x[np.arange(len(x)), chosen]
    np.exp(x, out=x)
    return (picked - np.log(x @ np.ones(x.shape[1], np.float32))).astype(np.float64)


class Vocabulary:
    """Hashes of the network's words by rank; everything else is the tail sign, the last word."""

    def __init__(self, hashes: list[int]) -> None:
        ranked = np.array(hashes, np.int64).view(np.uint64)
        order = np.argsort(ranked)
        self.sorted, self.rank = ranked[order], order
        self.tail = CLASSES * CLASS_WORDS - 1

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), self.tail)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.rank[at], self.tail)


def document_scores(net: Network, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log-probability of each whole document; ``tokens[first[d]:first[d + 1]]`` are the words of d.

    Documents run side by side, longest first; a window takes the next words of all that go on.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], first[:-1][order]
    out = np.zeros(len(order))
    start_sign = CLASSES * CLASS_WORDS
    h = np.zeros((len(order), UNITS), np.float32)
    a, longest = 0, int(sizes[0]) if len(sizes) else 0
    while a < longest:
        live = int(np.searchsorted(-sizes, -a, "left"))  # those longer than a
        width = min(max(WINDOW, WINDOW_TOKENS // live), longest - a)
        at = starts[:live, None] + a + np.arange(width)
        real = a + np.arange(width) < sizes[:live, None]
        words = tokens[np.where(real, at, starts[:live, None])]
        before = tokens[np.where(real & (at > starts[:live, None]), at - 1, starts[:live, None])]
        if a == 0:
            before[:, 0] = start_sign
        states, _ = net.states(before.T, h[:live], keep=False)
        h[:live] = states[-1]
        doc = np.nonzero(real)[0]
        got = net.log_probability(states.transpose(1, 0, 2)[real], words[real])
        out[order[:live]] += np.bincount(doc, got, minlength=live)
        a += width
    return out


def averaged(parts: DataFrame, rows: int) -> np.ndarray:
    """The mean of weight vectors (``body``), added up in tasks of about the square root of their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for body, k in zip(batch.column("body").to_pylist(), batch.column("n").to_pylist(), strict=True):
                v = np.frombuffer(body, np.float32).astype(np.float64) * k
                total, n = v if total is None else total + v, n + k
        if n:
            yield pa.RecordBatch.from_pydict(
                {"body": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), "n": pa.array([n], pa.int64())}
            )

    schema = "body binary, n long"
    some = parts.repartition(max(1, math.isqrt(rows))).mapInArrow(add, schema)
    (row,) = some.repartition(1).mapInArrow(add, schema).collect()
    return np.frombuffer(row[0], np.float32)


def trained(blocks: DataFrame, training, vocabulary: Vocabulary, counts: np.ndarray, rounds: int) -> Network:
    """The network after ``rounds`` of learning in every block and averaging; each round has its own tokens."""
    net = Network.fresh(counts)

    def divide(table: pa.Table) -> list[tuple[int, bytes]]:
        parts = parts_of(vocabulary.numbers(training(table)), rounds)
        return [(k, squeeze(part)) for k, part in enumerate(parts)]

    samples = cut(asked(blocks, divide)) if rounds else None
    for k in range(rounds):
        start = net.vector()
        mine = samples.where(F.col("segment") == k)
        n = mine.count()
        if not n:
            continue

        def learn(batches: Iterator[pa.RecordBatch], start: np.ndarray = start) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column("body").to_pylist():
                    part = unsqueeze(body)[0]
                    one = Network.flat(start)
                    one.learn(streams_of(part))
                    yield pa.RecordBatch.from_pydict(
                        {"body": pa.array([one.vector().tobytes()], pa.binary()), "n": pa.array([len(part) - 1], pa.int64())}
                    )

        parts = cut(mine.select("body").repartition(max(1, min(n, 4096))).mapInArrow(learn, "body binary, n long"))
        net = Network.flat(averaged(parts, n))
    return net


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out=in_sample, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents under word counts and under the network (columns of ``SCORES``).

    Both are base-10 log-probabilities of the whole text with its end sign. Words are lower-case
    in A-Z. ``base_score`` adds up ``log10((c + 1) / (N + V + 1))``; ``score`` is the network's,
    in which a word outside its vocabulary has the chance of the tail sign times
    ``(c + 1) / (T + D + 1)``, for T training tokens of D distinct tail words. A null or empty
    text is the end sign alone. Rows with one id are documents of their own; the id null counts
    as empty text in ``held_out``. Without training documents N and V are 0. Words are told
    apart by 64-bit hashes. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = cut(packed(docs, limit=BLOCK_BYTES, even=True))
    segments = -(-max(total_words(blocks), 1) // SEGMENT_WORDS)

    def shares(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seg = (mix(known, 8) % np.uint64(segments)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        return order, cuts(seg[order], segments)

    def ask(table: pa.Table) -> list[tuple[int, bytes]]:
        tokens = Tokens(table, "text", "doc_id", held_out)
        known, count, _ = tokens.distinct()
        order, at = shares(known)
        return [
            (s, squeeze(known[order[a:b]], count[order[a:b]].astype(np.uint32)))
            for s, a, b in zip(range(segments), at[:-1], at[1:], strict=True) if b > a
        ]

    def summed(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        parts = [unsqueeze(b) for b in bodies]
        known, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(where, np.concatenate([p[1] for p in parts]), minlength=len(known)).astype(np.uint64)
        return known, total[where], [len(p[0]) for p in parts]

    def answer(bodies: list[bytes]) -> list[bytes]:
        _, counts, sizes = summed(bodies)
        narrow = counts.astype(np.uint32) if len(counts) and counts.max() < 2**32 else counts
        return [squeeze(c) for c in np.split(narrow, np.cumsum(sizes)[:-1])]

    requests = cut(asked(blocks, ask))
    most = CLASSES * CLASS_WORDS - 1

    def tally(table: pa.Table) -> pa.Table:
        """Totals of a segment and its most frequent training words."""
        bodies = [unsqueeze(b) for b in table.column("body").to_pylist()]
        known, where = np.unique(np.concatenate([p[0] for p in bodies]), return_inverse=True)
        total = np.bincount(where, np.concatenate([p[1] for p in bodies]), minlength=len(known)).astype(np.int64)
        top = np.lexsort((known, -total))[:most]
        top = top[total[top] > 0]
        return pa.table(
            {
                "word": pa.array([None, *known[top].view(np.int64).tolist()], pa.int64()),
                "n": pa.array([int(total.sum()), *total[top].tolist()], pa.int64()),
                "distinct_words": pa.array([int((total > 0).sum()), *[0] * len(top)], pa.int64()),
            }
        )

    tallies = cut(requests.groupBy("segment").applyInArrow(tally, "word long, n long, distinct_words long"))
    totals = tallies.where("word is null").agg(F.sum("n"), F.sum("distinct_words")).first()
    train_tokens, train_words = totals[0] or 0, totals[1] or 0
    top = tallies.where("word is not null").orderBy(F.desc("n"), "word").limit(most).collect()
    vocabulary = Vocabulary([r[0] for r in top])
    in_top = sum(r[1] for r in top)
    counts = np.zeros(most + 1)
    counts[: len(top)] = [r[1] for r in top]
    counts[most] = train_tokens - in_top
    tail_total = train_tokens - in_top + train_words - len(top) + 1
    net = trained(blocks, lambda table: Tokens(table, "text", "doc_id", held_out).training(), vocabulary, counts, rounds)
    ratio = tail_total / (counts[most] + 0.1) * (train_tokens + 0.1) / (train_tokens + train_words + 1)
    weights = net.with_tail(ratio, float((counts[most] + 0.1) / (counts[-CLASS_WORDS:] + 0.1).sum())).vector()
    answers = answered(requests, answer).withColumn("kind", F.lit("counts"))

    def finish(table: pa.Table, bodies: dict[tuple, bytes], block: int) -> pa.Table:
        tokens = Tokens(table, "text", "doc_id", held_out)
        known, _, where = tokens.distinct()
        order, at = shares(known)
        count = np.zeros(len(known), np.int64)
        for s, a, b in zip(range(segments), at[:-1], at[1:], strict=True):
            if b > a:
                count[order[a:b]] = unsqueeze(bodies["counts", s])[0]
        n = len(tokens.ids)
        c = count[where]
        base = np.bincount(tokens.doc, np.log10((count + 1) / (train_tokens + train_words + 1))[where], minlength=n)
        numbers = vocabulary.numbers(known)
        tail = np.where(numbers == vocabulary.tail, np.log10((count + 1) / tail_total), 0.0)
        network = document_scores(Network.flat(weights), numbers[where], tokens.first) / math.log(10)
        network += np.bincount(tokens.doc, tail[where], minlength=n)
        return pa.table(
            {
                "doc_id": pa.array(tokens.ids, pa.int64()), "held_out": pa.array(tokens.held_out),
                "n_tokens": pa.array(np.diff(tokens.first), pa.int64()),
                "n_known": pa.array(np.bincount(tokens.doc[c > 0], minlength=n), pa.int64()),
                "train_tokens": pa.array([train_tokens] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(network),
            }
        )

    return with_answers(blocks, answers, finish, SCORES)
