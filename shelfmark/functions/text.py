"""Column expressions for text: tokens, sentences, labels and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the text rules see it, ideographs, sentence ends.
SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
IDEOGRAPH = r"\x{4e00}-\x{9fff}"
SENTENCE_END = "。！？!?.…"
_WORD = rf"[\p{{L}}\p{{N}}&&[^{IDEOGRAPH}]]+"
_IDEO = f"[{IDEOGRAPH}]"
# A word, a pair of neighbouring ideographs, or an ideograph standing alone.
TOKEN = f"(?=({_IDEO}{{2}}|{_WORD}|(?<!{_IDEO}){_IDEO}))(?:{_WORD}|{_IDEO})"

# Words a plain query plan drops.
STOP_WORDS = (
    "的 了 吗 呢 吧 啊 是 在 和 与 及 或 怎么 怎样 如何 什么 哪些 哪个 请问 我 你 他 "
    "这 那 这门 这个 一下 可以 需要 有没有 为什么 the a an is are of to and or how what "
    "which do does can i you for 在于"
).split()
# Characters that separate words of a plain query plan.
PLAN_SPLIT = r"[\s,，。、？?!！；;:：（）()\[\]【】\"'\-—/\\]+"
KEYWORD_LIMIT = 8


def strip(c: Column) -> Column:
    # One run to the end and back to the last visible character; a search for outer space would stop at every character.
    return F.regexp_extract(c, f"(?s)^{SPACE}*(.*[^{SPACE[1:]})?", 1)


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{SPACE[1:]}")


def tokens(c: Column) -> Column:
    """Search tokens in text order: lower-case words, ideograph runs as 2-grams."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def query_terms(c: Column, cap: int = 24) -> Column:
    return F.slice(F.array_distinct(tokens(c)), 1, cap)


def sentences(c: Column) -> Column:
    """Split behind a sentence end, swallowing the space that follows it."""
    parts = F.split(c, f"(?<=[{SENTENCE_END}]){SPACE}*", -1)
    return F.filter(parts, lambda s: ~blank(s))


def segments(body: Column) -> Column:
    """Blank-line paragraphs, each cut into sentences."""
    paras = F.filter(
        F.transform(F.split(body, f"\n{SPACE}*\n", -1), strip), lambda p: p != ""
    )
    return F.flatten(F.transform(paras, sentences))


def snippet(c: Column, n: int = 400) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def breadcrumb(path: Column, sep: str = " > ", empty: str = "（无标题）") -> Column:
    joined = F.array_join(path, sep)
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, joined).otherwise(F.lit(empty))


def page_label(start: Column, end: Column) -> Column:
    single = F.format_string("第%d页", (start + 1).cast("int"))
    ranged = F.format_string("第%d-%d页", (start + 1).cast("int"), (end + 1).cast("int"))
    return F.when(start == end, single).otherwise(ranged)


def safe_file_name(c: Column) -> Column:
    return strip(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]', "_"))


def section_number(c: Column) -> Column:
    return F.regexp_extract(c, r"第(\d+)节", 1).try_cast("int")


def strip_html(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", " "))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """``.ext`` of the last path part, or an empty string; a leading dot is no suffix."""
    return F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    base = base_name(name)
    return base.substr(F.lit(1), F.length(base) - F.length(suffix(name)))


def first_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def clean_keywords(words: Column, limit: int = KEYWORD_LIMIT) -> Column:
    """Trim, drop empty, keep first occurrences, at most ``limit``."""
    kept = F.filter(F.transform(words, strip), lambda w: w != "")
    return F.slice(F.array_distinct(kept), 1, limit)


def plain_keywords(c: Column, limit: int = KEYWORD_LIMIT) -> Column:
    """Keywords of a question without a planner: split, drop stop words."""
    words = F.split(c, PLAN_SPLIT, -1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(
        words,
        lambda w: (w != "")
        & ~F.array_contains(stop, F.lower(w))
        & ((F.length(w) >= 2) | w.rlike(r"^[\p{L}\p{N}]$")),
    )
    return F.slice(F.array_distinct(kept), 1, limit)


def strip_code_fence(c: Column) -> Column:
    """Drop a surrounding Markdown fence of a model answer."""
    t = strip(c)
    inner = F.regexp_replace(t, r"^```[^\n]*(\n|$)", "")
    inner = F.regexp_replace(inner, r"(^|\n)[ \t]*```[ \t]*$", "")
    return strip(F.when(t.startswith("```"), inner).otherwise(t))


def labelled_note(answer: Column, code: Column) -> Column:
    """Summary and core code out of a labelled model answer, with a cut fallback."""

    def last_of(label: str, number: str) -> Column:
        lines = F.filter(
            F.transform(F.split(answer, "\n"), strip),
            lambda s: s.startswith(label) | s.startswith(number),
        )

        def body(s: Column) -> Column:
            after = F.when(s.contains("]"), F.regexp_replace(s, r"^[^\]]*\]", "")).otherwise(
                F.regexp_replace(s, r"^[^.]*\.", "")
            )
            return strip(F.regexp_replace(strip(after), "^:+", ""))

        return F.coalesce(F.try_element_at(F.transform(lines, body), F.lit(-1)), F.lit(""))

    summary, core = last_of("[功能说明]", "1."), last_of("[核心代码]", "2.")
    none = (summary == "") & (core == "")
    return F.struct(
        F.when(none, F.substring(answer, 1, 200)).otherwise(summary).alias("summary"),
        F.when(none, F.substring(code, 1, 500)).otherwise(core).alias("core"),
    )
