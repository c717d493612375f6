"""Token alignment against both tokenizers' own output, set intersections and all pairs counted one by one."""

import collections
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import alignment

BITS = [
    "a", " ", "  ", "\n", "\t", "é", "中", "文字", "<s>", "</s>", "<unk>", "<|endoftext|>", "'s", "don't", "12345", "\x00", "\x1c", " ", "　",
    "😀", "<0x41>", "ǆ", "ﬁ", "é", "...", " word", " Über", "ß", "​", "﻿", " the", " internationalisation", "हिन्दी", "\r\n",
]


def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(a, b, text):
    """[(id, bytes)] of both sides, straight from the libraries."""
    from tokenizers.pre_tokenizers import ByteLevel

    if not text:
        return [], []
    full = " " + text
    signs = {c: i for c, i in alignment.byte_signs().items()}
    assert set(signs) == set(ByteLevel.alphabet())
    enc = a.encode(full, add_special_tokens=False)
    left = [(i, bytes(signs[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = full.encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def plain(texts):
    a, b = both()
    docs = []
    for text in texts:
        left, right = tokens(a, b, text)
        end = lambda side: np.cumsum([len(x) for _, x in side]).tolist()
        shared = sorted(set(end(left)) & set(end(right)))
        part = lambda side: [[i for (i, _), e in zip(side, end(side), strict=True) if lo < e <= hi] for lo, hi in zip([0, *shared], shared)]
        docs.append(list(zip(part(left), part(right), strict=True)))
    links = [collections.Counter((x, y) for ga, gb in d for x in ga for y in gb) for d in docs]
    count = collections.Counter(p for c in links for p in c)
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for d, c in zip(docs, links, strict=True):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d)
        out.append((
            sum(len(x) for x, _ in d), sum(len(y) for _, y in d), len(d), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(line.encode()).hexdigest() if d else "",
        ))
    return out


def texts_of(rng):
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(120)]
    return [*texts, None, "", " ", "   ", "▁ hidden", "\n", *texts[:20], "".join(rng.choice(BITS) for _ in range(1500)), "x" * 2000, "中" * 900]


@pytest.mark.parametrize(("block", "large", "links"), [(4 << 20, 1 << 12, 1 << 22), (2000, 2, 50)])
def test_rows_are_those_of_all_pairs(spark, monkeypatch, block, large, links):
    texts = texts_of(random.Random(4))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = [(None if i == 7 else i, t, 1, 2, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, pair int, links string").repartition(3)
    got = alignment.alignments(df).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, plain(texts), strict=True))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignments(df).collect() == []
    none = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.alignments(none).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 40)
    a, b = both()
    rng = random.Random(8)
    texts = texts_of(rng)
    for some in (texts[:50], texts[50:], texts[:3]):
        for text, (x, y) in zip(some, alignment.words_of(None, None).ids(some), strict=True):
            left, right = tokens(a, b, text)
            assert np.frombuffer(x, "<u2").tolist() == [i for i, _ in left] and np.frombuffer(y, "<u2").tolist() == [i for i, _ in right]


def test_cuts_are_the_common_ends():
    rng = random.Random(6)
    for _ in range(300):
        first_a, first_b, ends_a, ends_b, at = [0], [0], [], [], 0
        want = []
        for _doc in range(rng.randrange(5)):
            n = rng.choice([0, 1, 2, 30, 200])
            inner = list(range(at + 1, at + n))
            x, y = (sorted(rng.sample(inner, rng.randrange(len(inner) + 1))) + [at + n] if n else [] for _ in range(2))
            ends_a += x
            ends_b += y
            want += sorted(set(x) & set(y))
            first_a.append(len(ends_a))
            first_b.append(len(ends_b))
            at += n
        ea, eb = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
        end_a, end_b = alignment.groups(ea, eb, np.array(first_a), np.array(first_b))
        assert ea[end_a - 1].tolist() == eb[end_b - 1].tolist() == want


def test_a_block_is_made_part_by_part(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(15_000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    assert 3 << 20 < batch.column("text").nbytes < alignment.BLOCK_BYTES

    class Task:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run(iter([batch])))

    alignment.words_of(None, None).ids(["a"])
    tracemalloc.start()
    try:
        blocks = alignment.linked(Task(), "text", "doc_id", None, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(blocks) == 1
    assert peak < 100 << 20, peak >> 20


def test_words_in_use_outlive_the_others(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 40)
    words, learned = alignment.Words(None, None), []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda pieces: (learned.extend(pieces), learn(pieces)))
    for i in range(5):
        words.ids(["the cat sat " + " ".join(f"w{i}x{j}" for j in range(30))])
    assert learned.count(" cat") == 1 and len(words) <= 40
