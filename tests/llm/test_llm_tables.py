"""Archives, classifier, decontamination, licences and the pipeline."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import textwrap
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import cotrain, decontaminate, licences, warc

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def sentence(rng, n, words=3000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# archives -------------------------------------------------------------------------


def pages(rng):
    hot = "<p>" + sentence(rng, 60) + "</p>"
    trap = "x" * 120 + "\x1f\x08 WARC/1.1\r\n\r\n" + "".join(chr(rng.randrange(1, 255)) for _ in range(5000))
    rows = [(i, f"http://h/{i}\r\nEvil: 1", hot if i % 3 == 0 else sentence(rng, i)) for i in range(120)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", trap), (203, "é", trap), (None, "u", hot), (None, None, "only null " * 30)]
    rows += [(204, "u", "y" * 99), (205, "u", "y" * 99), (206, "u", "é" * 50), (207, "u", "é" * 50), (6, "again", hot), (208, "u", sentence(rng, 60_000))]
    return rows


@pytest.mark.parametrize("split", [1000, 8 << 20])
def test_archives(spark, split):
    rows = pages(random.Random(1))
    df = spark.createDataFrame([(*r, "e", "p", 5) for r in rows], "page_id long, url string, html string, record_type string, path string, salt int")
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = body in first and first[body] != i
        want.append((str(i), "revisit" if revisit else "response", str(first[body]) if revisit else None, hashlib.sha256(body).hexdigest(), len(body)))
    got = warc.archived(df.repartition(3), split=split).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in got if r.refers_to) == sorted(w for w in want if w[2])
    key = lambda w: (w[0], w[1], w[2] or "", w[3], w[4])
    assert sorted(key((r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes)) for r in got) == sorted(map(key, want))
    assert warc.archived(df.limit(0)).count() == 0


def test_members_at_any_split_and_damage():
    rng = random.Random(2)
    records = [warc.record("response", str(i), None, None, rng.randbytes(rng.randrange(3000))) for i in range(40)]
    raw = b"".join(records)
    for size in (1, 7, 333, 5000, len(raw)):
        found = []
        for start in range(0, len(raw), size):
            data = warc.Range(lambda at, n: raw[at : at + n], start)
            found += [warc.parsed(r)[0] for r in warc.members(data, start, start + size)]
            if size == 1 and start > 4000:
                break
        assert found == [str(i) for i in range(40)][: len(found)] and (size == 1 or len(found) == 40)
    hurt = bytearray(raw)
    at = len(records[0]) + len(records[1]) // 2
    hurt[at : at + 8] = b"\x1f\x8b\x08\x00\x00\x00\x00\x00"
    data = warc.Range(lambda at, n: bytes(hurt[at : at + n]), 0)
    ids = [warc.parsed(r)[0] for r in warc.members(data, 0, len(hurt))]
    assert ids == ["0", *[str(i) for i in range(2, 40)]]


# classifier -----------------------------------------------------------------------


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(rng, rng.randrange(30, 90), 300)
        if bad:
            text = text.upper() + "!!" if i % 8 else text + " nasty " + sentence(rng, 5, 300)
        docs.append((i, text, "de" if bad and i % 3 else "en", f"s{i % 5}", len(text), 0.5))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad and i % 8 else 1, 1 if bad and not i % 8 else 0))
    docs += [(None, None, None, None, None, 0.1), (n, "", "en", "s1", 0, 0.1), (n + 1, None, "en", "s1", 0, 0.1), (4, "again", "en", "s1", 5, 0.1)]
    labels += [(4, None, None), (None, 1, 0), (n + 7, 1, 0), (8, 1, None)]
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long, p_good double"


def test_cotraining_on_held_out_rows(spark):
    docs, labels = labelled(random.Random(3), 1200)
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = cotrain.scored(df, lf)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "p_text", "p_meta", "p_good", "keep"]
    rows = got.collect()
    assert len(rows) == len(docs)
    known = {r[0] for r in labels if r[0] is not None}
    fresh = [r for r in rows if r.doc_id is not None and r.doc_id < 1200 and r.doc_id not in known and r.text != "again"]
    bad = [r for r in fresh if r.doc_id % 4 == 0]
    good = [r for r in fresh if r.doc_id % 4]
    assert not bad or sum(not r.keep for r in bad) / len(bad) > 0.9
    assert sum(r.keep for r in good) / len(good) > 0.99
    named = [r for r in rows if r.doc_id in known and r.doc_id < 1200 and r.text != "again"]
    assert sum(r.keep == (r.doc_id % 4 != 0) for r in named) / len(named) > 0.97


def test_threshold_weighs_missed_bad_against_lost_good():
    rng = np.random.default_rng(7)
    for shift in (0.5, 2.0, 5.0):
        good = rng.random(2000) < 0.76
        z = np.where(good, rng.normal(shift, 2, 2000), rng.normal(-shift, 2, 2000)).round(1)
        wrong = lambda c: (z[good] < c).sum() + (z[~good] >= c).sum()  # noqa: B023, E731
        assert wrong(cotrain.weighed(z, good)) == min(wrong(c) for c in [*z, z.max() + 1])
    even = np.array([-3.0, -2.0, 4.0, 5.0])
    assert cotrain.weighed(even, even > 0) == 0.0


def test_trained_threshold_is_the_weighed_one(spark, monkeypatch):
    docs, labels = labelled(random.Random(3), 600)
    df, lf = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(cotrain, "weighed", lambda z, good, f=cotrain.weighed: seen.append(f(z, good)) or seen[-1])
    assert math.isclose(cotrain.trained(df, lf).threshold, 1 / (1 + math.exp(-seen[0])), rel_tol=1e-9)


def test_classifier_without_labels(spark):
    docs, labels = labelled(random.Random(3), 40)
    df = spark.createDataFrame(docs, DOCS)
    none = cotrain.scored(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("keep and p_good is null").count() == len(docs)
    one = spark.createDataFrame([(1, 1, 0)] * 5, "doc_id long, quality int, toxic int")
    assert cotrain.scored(df.select("doc_id", "text"), one).where("keep").count() == len(docs)
    assert cotrain.scored(df.limit(0), one).count() == 0


def test_pseudo_labels_are_exchanged(spark):
    docs, labels = labelled(random.Random(5), 1500)
    df, lf = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    alone, taught = cotrain.trained(df, lf, rounds=0), cotrain.trained(df, lf, rounds=2)
    assert not np.array_equal(alone.meta.weight, taught.meta.weight)


# decontamination ------------------------------------------------------------------


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def plain(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub(r"[!-/:-@\[-`{-~]", " ", (text or "").lower()))


def test_alignment_equals_plain_dynamic_programming():
    rng = np.random.default_rng(4)
    items = [rng.integers(2, 6, n).astype(np.uint64) for n in (1, 5, 9, 14)]
    passages = [rng.integers(2, 6, n).astype(np.uint64) for n in (3, 5, 20, 11)]
    score, end = decontaminate.aligned(decontaminate.padded(items, 0), decontaminate.padded(passages, 1))
    for a, b, s, e in zip(items, passages, score, end, strict=True):
        assert s == smith_waterman(a.tolist(), b.tolist()) == smith_waterman(a.tolist(), b[:e].tolist())


@pytest.mark.parametrize(("block_words", "held"), [(5, 8), (1 << 20, 8), (1 << 20, 0)])
def test_leaks(spark, monkeypatch, block_words, held):
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = random.Random(6)
    items = [(k, sentence(rng, 18 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "w1 w2"), (3, "other text of item three here")]
    edit = items[5][1].split()
    edit[7:8] = ["new", "words"]
    del edit[14]
    rows = [(i, sentence(rng, 80)) for i in range(40)]
    rows += [(100, sentence(rng, 30) + " " + items[2][1].upper() + "! " + sentence(rng, 30)), (101, " ".join(edit)), (102, items[4][1] + " " + sentence(rng, 5000) + " " + items[4][1])]
    rows += [(103, None), (104, ""), (None, items[9][1]), (100, "same id"), (105, items[0][1][: len(items[0][1]) // 5])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, item_id int, score double").repartition(3)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = decontaminate.leaks(df, bench, block_words=block_words).collect()
    want = {}
    for i, t in rows:
        for k, q in items:
            a, b = plain(q), plain(t)
            if len(a) >= 3 and b and (s := smith_waterman(a, b)) >= 0.5 * len(a):
                want[i, k] = s / len(a)
    assert {(r.doc_id, r.item_id): r.score for r in got} == want and len(want) >= 4
    for r in got:
        assert 0 <= r.start_word < r.end_word
    clean = decontaminate.without_leaks(df, bench, block_words=block_words)
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in rows if not any(w[0] == i and t != "same id" for w in want))
    assert decontaminate.leaks(df.limit(0), bench).count() == 0
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(rows)


@pytest.mark.parametrize("held", [8, 0])
@pytest.mark.parametrize("intact_copy", [False, True])
def test_copies_with_every_few_words_edited(spark, monkeypatch, intact_copy, held):
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = random.Random(8)
    items = [(k, sentence(rng, 16 + k)) for k in range(24)]
    rows = [(i, sentence(rng, 60)) for i in range(10)]
    for k, text in items:
        step = 4 + k % 3
        words = [f"new{i}" if i % step == k % 4 else w for i, w in enumerate(text.split())]
        if k % 8 == 7:
            words = [x for i, w in enumerate(text.split()) for x in ([w, "added"] if i % 3 == 2 else [w])]
        rows.append((len(rows), " ".join([sentence(rng, 30), *words, sentence(rng, 30)])))
    if intact_copy:
        rows += [(1000 + k, text) for k, text in items]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    want = {}
    for i, t in rows:
        for k, q in items:
            if (s := smith_waterman(plain(q), plain(t))) >= 0.5 * len(plain(q)):
                want[i, k] = s / len(plain(q))
    assert got == want and len(want) >= 20


def test_items_with_a_shared_opening(spark, monkeypatch):
    """Common openings, repeated words and equal items: either way of joining gives what the plain recursion gives."""
    rng = random.Random(12)
    opening = "choose the best answer below"
    items = [(k, " ".join([opening, *(f"v{rng.randrange(40)}" for _ in range(3 + k % 9))])) for k in range(60)] + [(99, opening), (98, opening)]
    rows = [(k, " ".join(f"v{rng.randrange(40)}" if rng.random() < 0.7 else opening for _ in range(40))) for k in range(30)]
    rows += [(100 + k, f"v1 {t} v2") for k, t in items[::7]]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k): s / len(plain(q)) for i, t in rows for k, q in items if (s := smith_waterman(plain(q), plain(t))) >= 0.5 * len(plain(q))}
    for held in (0, 8, 1000):
        monkeypatch.setattr(decontaminate, "HELD", held)
        assert {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()} == want and len(want) > 100


def test_a_common_opening_of_many_items_costs_seconds():
    rng = random.Random(13)
    opening = "read the passage and answer"
    items = [" ".join([opening, *(f"v{rng.randrange(20000)}" for _ in range(10))]) for _ in range(16000)]
    texts = [" ".join([f"v{rng.randrange(20000)}" for _ in range(20)] + opening.split()) for _ in range(7000)]
    for k in range(50):
        texts[100 * k] += " " + items[300 * k]
    texts = [t.encode() for t in texts]
    assert sum(map(len, texts)) > 1_000_000
    block = decontaminate.Items(list(range(len(items))), [t.encode() for t in items], decontaminate.NGRAM)
    words = decontaminate.plain(texts)
    met = [collections.Counter(h.tolist()) for h in (words.run_hash(words.runs(3)[0], 3), words.hash)]
    counts = [np.array([n[x] for x in keys.tolist()]) for keys, n in zip((block.known, block.known_words), met, strict=True)]
    block.seeded(*counts, 0.5)
    start = time.process_time()
    got = decontaminate.found(texts, block, 0.5)
    assert time.process_time() - start < 20
    assert {(100 * k, 300 * k) for k in range(50)} <= {r[:2] for r in got}
    for d, i, score, m, *_ in got:
        assert smith_waterman(plain(items[i]), plain(texts[d].decode())) == round(score * m)


# licences -------------------------------------------------------------------------


def test_notices_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "no notice"), (3, "a/b/c/COPYING", "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"),
        (4, "a/b/c/d/y.py", "nothing here"), (5, "a/b/c/d/z.py", "# SPDX-License-Identifier: GPL-3.0\ncode"), (6, "e/f.py", "a licence to talk about, in a long sentence of other things entirely"),
        (7, None, "Licensed under CC BY-NC 4.0."), (8, "a/n.py", None), (9, "a/m.py", ""), (10, "LICENSE.txt", "Released under the 3-clause BSD License"), (11, "q/r.py", "x"),
        (None, "a/k.py", "Released under the MIT License."), (12, "ab/LICENSE", "This work is licensed under the GNU General Public License, version 2. " + "long " * 3000), (1, "a/LICENSE", "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, path string, body string, licence string, salt int").repartition(2)
    got = licences.scanned(df, "id", "path", "body").collect()
    assert len(got) == len(rows)
    by = {r.id: (r.own_licence, r.licence, r.licence_dir) for r in got}
    assert by[1] == ("MIT", "MIT", None) and by[2] == (None, "MIT", "a") and by[3] == ("Apache-2.0", "Apache-2.0", None)
    assert by[4] == (None, "Apache-2.0", "a/b/c") and by[5] == ("GPL-3.0", "GPL-3.0", None) and by[6] == (None, "BSD-3-Clause", "")
    assert by[7] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None) and by[8] == by[9] == (None, "MIT", "a") and by[11] == (None, "BSD-3-Clause", "")
    assert by[None] == (None, "MIT", "a") and by[12][0] == "GPL-2.0"
    assert licences.scanned(df.limit(0), "id", "path", "body").count() == 0


def test_cosine_equals_plain_arithmetic(spark):
    """Every piece against every template, with rarities over all texts and no choice of candidates."""
    texts = [
        (1, "Licensed under the Apache License"), (2, "licensed by the state, not the Apache License\nThe MIT License"), (3, "copyright somebody"),
        (4, "x = 1\n# Licensed under\n#\n# the Apache\n# License\ny = 2"), (5, "the MIT\nLicense\n\nand more of it"), (6, "/* the\n MIT License */ code(); it's"), (7, ""), (8, None),
    ]
    templates = (("A", "Licensed under the Apache License"), ("M", "the MIT License"), ("T", "it's a licence"))
    blocks = {4: ["Licensed under the Apache License"], 6: ["the MIT License"]}
    paragraphs = {4: ["x = 1 Licensed under", "the Apache License y = 2"], 5: ["the MIT License", "and more of it"]}
    split = lambda s: [t for t in re.split(r"[^\w]+", s.lower()) if t]
    whole = [split(t) for _, t in texts if t is not None]
    df = collections.Counter(t for p in whole for t in set(p))
    vec = lambda ts: {t: (1 + math.log(n)) * (math.log((1 + len(whole)) / (1 + df[t])) + 1) for t, n in collections.Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    frame = spark.createDataFrame(texts, "id long, body string")
    for least in (0.1, 0.6, 0.9):
        got = {r.id: (r.licence, r.cosine) for r in licences.notices(frame, "id", "body", templates, least).collect()}
        want = {}
        for i, s in texts:
            for piece in [s or "", *(s or "").split("\n"), *blocks.get(i, []), *paragraphs.get(i, [])]:
                for name, t in templates if split(piece) else ():
                    a, b = vec(split(piece)), vec(split(t))
                    c = round(sum(x * b.get(k, 0) for k, x in a.items()) / norm(a) / norm(b), 6)
                    if c >= least:
                        want[i] = min(want.get(i, (0, "")), (-c, name))
        assert {i: (n, pytest.approx(-c, abs=2e-6)) for i, (c, n) in want.items()} == got and got
    assert licences.notices(frame, "id", "body", ()).count() == 0


def test_headers_and_licence_texts_in_common_use(spark):
    """Each is wrapped at 72 signs, plain and in comments, before code and prose; the licence is that of its words."""
    gnu = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n\nIt is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
    bsd = ["Copyright (c) 2019, Jane Doe\nAll rights reserved.", *re.split(r"(?= [123]\. )", licences.BSD_TWO), licences.BSD_THIRD, licences.BSD_REST.replace("HOLDERS", "OWNERS")]
    cases = {
        **{n: gnu.format("Foo", f"{k}", v, k) for n, k, v in [
            ("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-3.0", "Lesser General Public License", 3), ("AGPL-3.0", "Affero General Public License", 3)]},
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "BSD-2-Clause": "\n\n".join(bsd[:-2] + bsd[-1:]), "BSD-3-Clause": "\n\n".join(bsd), "MIT": "The MIT License\n\nCopyright (c) 2001 A. U. Thor\n\n" + licences.MIT_GRANT + "\n\n" + licences.MIT_REST,
        "Apache-2.0": "Copyright 2020 The Foo Authors\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    }
    rows, want = [], {}
    for name, text in cases.items():
        lines = [w for line in text.split("\n") for w in (textwrap.wrap(line, 72) or [""])]
        for open_, mark, close in [("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("/*\n", "  ", "\n*/")]:
            body = open_ + "\n".join((mark + x).rstrip() for x in lines) + close
            want[len(rows)] = name
            rows.append((len(rows), body if not mark else body + "\n\nimport os\nprint(os.name)\n"))
    rows += [(1000 + k, f"A page about the history of town {k}, its public library, and the general terms of use of software there.") for k in range(60)]
    got = {r.id: r.licence for r in licences.notices(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    assert got == want


# pipeline -------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    docs, labels = labelled(rng, 600)
    passage = sentence(rng, 45, 10**6)
    item = sentence(rng, 30, 10**6)
    copy = sentence(rng, 60, 10**6)
    around = [sentence(rng, 40, 300) for _ in range(2)]
    extra = [(9000, copy), (9001, copy), (9002, copy.rsplit(" ", 4)[0] + " end of it all"), (9003, around[0] + " " + passage), (9004, passage + " " + around[1]), (9005, "w7 w8 " + item + " w9")]
    docs = [(*d[:5],) for d in docs] + [(i, t, "en", "s1", len(t)) for i, t in extra]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = {}
    current = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = current
        stage(spark, current, folder).write.parquet(f"{folder}/{name}")
        current = spark.read.parquet(f"{folder}/{name}")
        held[name] = {r.doc_id: r for r in current.collect()}
        assert name == "packing" or current.columns == before.columns
    kept = {i for i, *_ in extra}
    assert kept <= set(held["quality"]) and not {12, 16} <= set(held["quality"])
    assert {9000} == {9000, 9001, 9002} & set(held["near_dedup"])
    assert held["substring_dedup"][9003].text == extra[3][1] and held["substring_dedup"][9004].text == around[1]
    assert held["substring_dedup"][9004].n_chars == len(around[1])
    assert 9005 not in held["decontaminate"] and set(held["decontaminate"]) == set(held["substring_dedup"]) - {9005}
    assert set(held["packing"]) == set(held["decontaminate"])
    ran = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d"))
    assert ran.where("n != d and doc_id is not null").count() == 0 and ran.count() == len(held["packing"])


def test_contract_columns(spark):
    from shelfmark.llm.queries import ORACLES, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
    assert zlib.crc32(b"") == 0
