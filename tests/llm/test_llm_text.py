"""Operators on texts against brute force, with the awkward rows that tables hold."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import dart, fingerprint, packing, recurrent, ring, substring
from shelfmark.llm.words import Words

TEXT = "doc_id long, text string, lang string, source string, n_chars long, block long, kept_text string, cell int, rank int, node string"


def frame(spark, rows, parts=3):
    """Documents with extra columns named like the ones operators make."""
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "x", 1, 2, "n") for i, t in rows]
    return spark.createDataFrame(full, TEXT).repartition(parts)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [sentence(rng, n) for n in (60, 90, 200, 35, 19, 20, 21, 400)]
    shared = sentence(rng, 45)
    edited = base[2].split()
    edited[17] = edited[120] = "changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, " ".join(edited)), (23, None), (24, ""), (25, " \n\t "), (26, "one"), (27, "one two")]
    rows += [(28, sentence(rng, 30) + "\n" + shared), (29, shared + "  " + sentence(rng, 30)), (30, shared + " " + shared)]
    rows += [(31, "é" * 50 + " x y \x85 " + sentence(rng, 25)), (31, "one"), (None, base[1]), (33, sentence(rng, 3000, 40))]
    rows += [(34, sentence(rng, 20)), (34, None), (20, base[0])]
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words(corpus):
    texts = [None if t is None else t.encode() for _, t in corpus]
    got = Words(texts)
    assert got.counts.tolist() == [len(words(t)) for _, t in corpus]
    names = [w for _, t in corpus for w in words(t)]
    assert len(set(names)) == len(set(got.hash.tolist())) == len(set(zip(names, got.hash.tolist(), strict=True)))
    starts, _ = got.runs(7)
    runs = [tuple(names[s : s + 7]) for s in starts]
    assert len(set(runs)) == len(set(zip(runs, got.run_hash(starts, 7).tolist(), strict=True)))


def brute_windows(rows, size):
    first = {}
    low = lambda i: -math.inf if i is None else i
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (math.inf, 0)), (low(i), k))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (low(i), k):
                gone |= set(range(k, k + size))
        out.append((i, t, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("segment", [64, 1 << 20])
def test_substring(spark, corpus, segment):
    got = substring.without_repeats(frame(spark, corpus), segment=segment)
    assert got.columns == [c for c in TEXT.replace(",", "").split()[0::2] if c != "kept_text"] + ["kept_text", "n_words", "n_removed"]
    rows = [(r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute_windows(corpus, 20), key=str)
    assert any(r[3] for r in rows)
    assert substring.without_repeats(frame(spark, [])).count() == 0


def test_shards(spark, corpus):
    rows = ring.sharded(frame(spark, corpus), shards=4, nodes=16, cells=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == len(corpus)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert ring.sharded(frame(spark, [])).count() == 0


def test_ring_moves_only_what_overflows():
    counts = {c: 1 + c % 5 for c in range(0, 256, 2)}
    runs = ring.walk(counts, 8, 32, 256, 0.25)
    bound = ring.bounds(sum(counts.values()), 8, 0.25)[0]
    nodes = ring.ring_nodes(8, 32, 256)
    home = {c: next((s for at, s in nodes if at >= c), nodes[0][1]) for c in counts}
    load, at_home = collections.Counter(), collections.Counter()
    for cell, low, high, shard, _ in runs:
        load[shard] += high - low + 1
        at_home[home[cell]] += high - low + 1 if shard == home[cell] else 0
    wanted = collections.Counter()
    for c, n in counts.items():
        wanted[home[c]] += n
    assert sum(load.values()) == sum(counts.values()) and max(load.values()) <= bound
    assert all(at_home[s] == min(wanted[s], bound) for s in wanted)
    more = ring.walk(counts, 9, 32, 256, 0.25)
    place = lambda rs: {(c, k): s for c, a, b, s, _ in rs for k in range(a, b + 1)}
    moved = sum(place(runs)[k] != s for k, s in place(more).items())
    assert moved < 0.5 * sum(counts.values())


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def weighted_jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def test_dart_signatures_estimate():
    rng = random.Random(5)
    a = sentence(rng, 300, 10**6).split()
    texts = [a, a[:150] + a[:150], a[:280] + ["x"] * 20, a[:100] * 4, ["y"] * 50 + a[:50]]
    texts = [" ".join(t) for t in texts]
    sets = dart.weighted_shingles([t.encode() for t in texts])
    signature = dart.dart_signatures(len(texts), *sets, 3000)
    for i in range(len(texts)):
        for j in range(i):
            exact = weighted_jaccard(shingles(texts[i]), shingles(texts[j]))
            assert abs((signature[i] == signature[j]).mean() - exact) < 0.05


def brute_classes(rows):
    nodes = sorted({t or "" for _, t in rows})
    root = {t: t for t in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {t: shingles(t) for t in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if sets[a] and weighted_jaccard(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        r = find(t or "")
        ids = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(ids) if ids else None
    return [(i, least[find(t or "")]) for i, t in rows]


def test_near_duplicates(spark, corpus):
    rng = random.Random(8)
    hub = sentence(rng, 160, 10**6).split()
    spokes = []
    for k in range(40):
        w = list(hub)
        for p in rng.sample(range(160), 3):
            w[p] = f"edit{k}-{p}"
        spokes.append((100 + k, " ".join(w)))
    rows = corpus + spokes + [(99, " ".join(hub))]
    got = dart.near_classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(brute_classes(rows), key=str)
    kept = dart.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert kept.count() == len({(r.class_id, r.doc_id, r.node) for r in got if r.first})
    assert dart.near_classes(frame(spark, [])).count() == 0


def test_mixed_buckets_are_compared_between_classes(spark):
    from shelfmark.llm.blocks import squeeze

    low = lambda s: bytes(np.random.default_rng(s).integers(0, 256, dart.COORDINATES, np.uint8))
    near = lambda i: squeeze(np.arange(100 if i < 4 else i, 150, dtype=np.uint64), np.ones(50 if i < 4 else 150 - i, np.uint32))
    body = lambda i: near(i) if i != 2 else squeeze(np.arange(130, dtype=np.uint64), np.ones(130, np.uint32))
    rows = [(1, 600, i * 7919, bytes([i % 256, i // 256]), bytes([i % 3]), low(1 if i < 4 else 10 + i), body(min(i, 4))) for i in range(600)]
    df = spark.createDataFrame(rows, "bucket long, n long, h long, node binary, root binary, low binary, body binary")
    got = {(bytes(r.a), bytes(r.b)) for r in dart.tiles(df, 0.8).collect()}
    one = lambda i: bytes([i, 0])
    # 0 and 3 are of one class already, 2 is like the others by signature only
    assert got and got <= {(one(0), one(1)), (one(1), one(3))}


def test_components(spark):
    from shelfmark.llm.components import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 201: 200}


def test_fingerprints(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows, 5)).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            a, b = set(shingles(t)), set(shingles(other))
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) < (0.12 if len(a | b) > 60 else 0.6)
    assert len({got[i].fingerprint for i in (0, 20, 21)}) == 1 and got[24].fingerprint == ""
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0
    (one,) = fingerprint.fingerprints(frame(spark, [(5, "a b c d")])).collect()
    assert one.near_next == 1.0
    twins = fingerprint.fingerprints(frame(spark, corpus)).collect()
    assert len(twins) == len(corpus)


def test_densification_and_bias():
    bins = np.full((3, 64), fingerprint.EMPTY)
    bins[1, 5] = 9
    bins[2, [1, 40]] = [3, 4]
    full = fingerprint.densified(bins)
    assert (full[0] == fingerprint.EMPTY).all() and (full[1] == 9).all() and set(full[2].tolist()) == {3, 4}
    a, b = np.random.default_rng(1).integers(0, 16, (2, 1, 100_000), np.uint8)
    has = np.array([True])
    assert fingerprint.likeness(a, b, has, has)[0] < 0.01 and fingerprint.likeness(a, a, has, has)[0] == 1.0


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(50, "a  b   c\n\n d \n e\t\tf 　 g's  "), (51, "  lead"), (52, "trail \n"), (53, "汉字 测试,   x \x1cy 12 3.5!!")]
    rows = [(k, t) for k, (_, t) in enumerate(corpus + odd)]
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in rows}
    got = packing.packed_sequences(frame(spark, rows)).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for k, want in ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == np.cumsum([0, *[r.length for r in w[:-1]]]).tolist()
        size = sum(r.length for r in w)
        assert size == w[0].sequence_tokens and size & (size - 1) == 0 and size <= 2048
    steps = collections.Counter()
    for w in windows.values():
        steps[w[0].step_id] += w[0].sequence_tokens
    assert max(steps.values()) <= packing.STEP_TOKENS
    assert packing.packed_sequences(frame(spark, [])).count() == 0


def test_tiers_are_full_and_short_documents_whole():
    packer = packing.Packer((256, 512, 1024, 2048))
    rng = random.Random(4)
    sizes = [rng.choice([rng.randrange(1, 300), rng.randrange(300, 2500)]) for _ in range(400)]
    for k, n in enumerate(sizes):
        packer.add(k, n)
    packer.rest()
    assert sum(s for s, _ in packer.windows) == sum(sizes) and not packer.open
    cut = collections.Counter(d for _, w in packer.windows for d, _, _ in w)
    assert sum(1 for k, n in enumerate(sizes) if n <= 2048 and cut[k] > 1) < 0.4 * len(sizes)
    assert all(sum(n for _, _, n in w) == s for s, w in packer.windows)


def test_language_scores(spark, corpus):
    rows = [(k, t) for k, (_, t) in enumerate(corpus)]
    got = {r.doc_id: r for r in recurrent.scored(frame(spark, rows), rounds=1).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {k: [*words((t or "").translate(lower)), None] for k, t in rows}
    count = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for k, ws in tokens.items():
        r = got[k]
        assert r.held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert recurrent.scored(frame(spark, [])).count() == 0
    assert recurrent.scored(frame(spark, [(None, None)])).first().n_tokens == 1


def test_every_training_token_is_learned_from(spark, monkeypatch):
    rng = random.Random(2)
    long = next(k for k in range(12) if not recurrent.in_sample(k))
    rows = [(k, sentence(rng, 40_000 if k == long else 300)) for k in range(12)]
    table = frame(spark, rows, 1).select("doc_id", "text").toArrow()
    tokens = recurrent.Tokens(table, "text", "doc_id", recurrent.in_sample)
    got = tokens.training()
    assert len(got) == sum(len(words(t)) + 1 for k, t in rows if not recurrent.in_sample(k)) > 40_000
    for n in (1, 2, 63, 64, 65, 1000, 4099):
        parts = recurrent.parts_of(np.arange(n) % 2000, 3)
        assert [x for p in parts for x in p[1:].tolist()] == (np.arange(n) % 2000).tolist()
        for part in parts:
            assert set(range(1, len(part))) == set(recurrent.streams_of(np.arange(len(part)))[:, 1:].reshape(-1).tolist())
    learned = []
    monkeypatch.setattr(recurrent, "averaged", lambda parts, n, f=recurrent.averaged: learned.append(parts.agg(F.sum("n")).first()[0]) or f(parts, n))
    assert recurrent.scored(frame(spark, rows)).first().train_tokens == sum(learned) == len(got)


def test_network_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    size = recurrent.CLASSES * recurrent.CLASS_WORDS
    streams = np.tile(np.arange(8), (4, 200))
    counts = np.bincount(streams.reshape(-1), minlength=size).astype(float)
    net = recurrent.Network.fresh(counts)
    h = rng.standard_normal((1, recurrent.UNITS)).astype(np.float32)
    assert abs(np.exp(net.log_probability(np.repeat(h, size, 0), np.arange(size))).sum() - 1) < 1e-3
    text, first = np.tile(np.arange(8), 10), np.array([0, 80, 80])
    before = recurrent.document_scores(net, text, first)
    net.learn(streams)
    after = recurrent.document_scores(net, text, first)
    assert after[0] > before[0] / 2 and after[1] == 0.0
    halves = recurrent.document_scores(net, text, np.array([0, 40, 80]))
    assert halves.sum() < after[0]  # the state is carried over the windows


def test_gradient():
    rng = np.random.default_rng(1)
    size = recurrent.CLASSES * recurrent.CLASS_WORDS
    net = recurrent.Network.fresh(rng.random(size) + 1)
    x, y = rng.integers(0, size, (2, 5, 3))
    start = np.zeros((3, recurrent.UNITS), np.float32)

    def loss():
        states, held = net.states(x, start)
        return -net.log_probability(states.reshape(-1, recurrent.UNITS), y.reshape(-1)).mean(), states, held

    _, states, held = loss()
    grad = net.gradient(x, y, states, held)
    for name in ("state", "input", "class_w", "gate"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        kept, eps = net.p[name][at], np.float32(1e-2)
        net.p[name][at] = kept + eps
        up = loss()[0]
        net.p[name][at] = kept - eps
        down = loss()[0]
        net.p[name][at] = kept
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 0.05 * abs(grad[name][at]) + 1e-4


def test_column_order_is_kept(spark):
    df = frame(spark, [(1, "a b")]).withColumn("zeta", F.lit(3))
    assert substring.without_repeats(df).columns[-4:] == ["zeta", "kept_text", "n_words", "n_removed"]


def test_added_tokens_are_those_of_the_vocabulary_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(12)
    sign = "<|endoftext|>"
    bits = [sign, sign + sign, " ", "  ", "\n", "a", " word", "é", "中", "<|", "|>", "endoftext", "<|endoftext", "'s", "12"]
    texts = [sign, f"{sign} a", f"a {sign}b", f" {sign} ", f"x{sign}{sign}y  {sign}", ""] + ["".join(rng.choice(bits) for _ in range(12)) for _ in range(2000)]
    pieces = packing.pieces_of(None)
    for text in texts:
        assert packing.token_ids(text, pieces).tolist() == [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID], repr(text)


def test_one_of_each_keeps_any_columns(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, i, str(i), i, 2 * i, i, 3.5) for i, t in enumerate([words, words + " x", "other text", None, words, "other text"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _node string, _own long, node long, first_id int, `a.b` double")
    kept = dart.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if r[0] in (0, 2, 3))
