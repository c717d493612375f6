"""Secrets in texts, found by one automaton of all rules in one pass over the bytes.

The pass marks the bytes at which a match of a rule may end. Only from the last byte of each run
of such ends the rule's automaton is walked back to the places where a match can begin, and from
the leftmost one that no earlier match covers forward to its longest end. Work besides the pass is
in proportion to what is found. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.automaton import Automaton, Expression, compiled
from shelfmark.llm.blocks import bytes_of, split_by_bytes

SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, longest, non-overlapping matches of a pattern of ASCII signs.

    ``least`` is the number of signs that the part of a match must have which can be cut short: from
    the first place where the match could end to where it does. A shorter match is dropped, yet what
    it covers is. A match that can end inside a run of ends must be able to end with the run, which
    holds for patterns that end in a repeated class and for those whose ends never touch.
    """

    kind: str
    pattern: str
    least: int = 1
    any_case: bool = False


# The kinds of the base, in order, and their patterns.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 10),
)
RULES = BASE + MORE


class Scanner:
    """The automaton of all rules and, for each rule, those that walk a match back and forward."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        parsed = [Expression(r.pattern, r.any_case) for r in rules]
        self.all: Automaton = compiled(parsed, anywhere=True)
        self.back = [compiled([e], anywhere=False, backward=True) for e in parsed]
        self.ahead = [compiled([e], anywhere=False) for e in parsed]
        self.marks = np.zeros(len(self.all.table), np.int32)
        self.marks[:: self.all.columns] = self.all.accept

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every text, in code points and in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        buf, states = self.all.run(texts)
        marks = self.marks[states]
        ends = np.flatnonzero(marks)
        if not len(ends):
            return out
        marks, data = marks[ends], buf.tobytes()
        begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
        for r, rule in enumerate(self.rules):
            mine = ends[(marks >> r & 1) == 1] + 1
            mine = mine[np.append(np.diff(mine) != 1, True)] if len(mine) else mine
            free = 0
            for doc, end in zip((np.searchsorted(begin, mine, "left") - 1).tolist(), mine.tolist(), strict=True):
                at = int(begin[doc])
                free = max(free, at)
                starts = [s + 1 for s in self.back[r].walk(data, end - 1, -1, at - 1) if s + 1 >= free]
                if not starts:
                    continue
                found = self.ahead[r].walk(data, min(starts), 1, at + len(texts[doc]))
                free = found[-1]
                if free - found[0] + 1 >= rule.least:
                    out[doc].append((min(starts) - at, r, free - at))
        for doc, held in enumerate(out):
            if held and not texts[doc].isascii():
                points = np.cumsum((np.frombuffer(texts[doc], np.uint8) & 0xC0) != 0x80)
                held[:] = [(int(points[s]) - 1, r, int(points[e - 1])) for s, r, e in held]
            held.sort()
        return out


def scanned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its secrets as ``kinds``, ``starts`` and ``ends`` (code points, end exclusive), by start and rule.

    A null or empty text has none. Rows with equal or null ids stay rows of their own. A text of any
    length is scanned whole. Other columns are not read.
    """
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in split_by_bytes(batch, "text", SLICE_BYTES):
                found = scanner.spans([t or b"" for t in bytes_of(part.column("text"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([[rules[r].kind for _, r, _ in f] for f in found], pa.list_(pa.string())),
                        pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "kinds", "starts", "ends"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, kinds array<string>, starts array<long>, ends array<long>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as ``kind:start:end``."""
    spans = scanned(docs).withColumn(
        "all", F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    )
    base = [r.kind for r in BASE]
    of_base = F.filter("all", lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(base))
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", kind))).cast("long").alias(f"n_{kind}") for kind in base]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(of_base, ","), 256).alias("base_sha256"), F.array_join("all", ",").alias("spans"))


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL: places of matches are sums of the lengths of the texts between them and of the matches."""
    legs = []
    for n, rule in enumerate(rules):
        pattern = rule.pattern
        if rule.any_case:  # letters of the words in either case, and no signs beyond ASCII
            head, tail = pattern.rsplit("[A-Za-z", 1)
            pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head.replace(r"\x20", " ")) + "[A-Za-z" + tail
        pattern = pattern.replace("'", "''")
        value = pattern.rindex("[A-Za-z") if rule.any_case else 0
        whole = f"{pattern[:value]}({pattern[value:]})"
        long_enough = {
            "assign": f"length(regexp_extract(m, '{whole}', 2)) >= 6", "access": "length(m) >= 20", "host": "length(m) >= 40",
            "chat": "length(m) >= 15",
        }
        legs.append(f"""SELECT r, {n} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT r, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)))
  WHERE {long_enough.get(rule.kind, "true")}""")
    union = "\n  UNION ALL ".join(legs)
    n_base = len(BASE)
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))
    line = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
h AS ({union}),
g AS (SELECT r, {counts}, coalesce(string_agg({line}, ',' ORDER BY s, k) FILTER (k < {n_base}), '') AS base,
             coalesce(string_agg({line}, ',' ORDER BY s, k), '') AS spans FROM h GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""
