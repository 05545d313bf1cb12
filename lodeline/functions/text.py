"""Text functions as Column expressions.

Text is taken to be in Unicode form NFKC, which Spark has no function for; the
``nfkc`` function normalises what isn't, once, at ingest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tokenize() leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on",
    "or", "the", "to", "what", "when", "where", "which", "who", "why", "do", "does", "did", "must", "have", "has", "with",
    "cua", "của", "la", "là", "gi", "gì", "nhung", "những", "cac", "các", "cho", "trong", "theo", "nhu", "như", "được",
    "và", "với", "khi", "nào", "bao", "nhiêu", "lâu", "người", "học",
)

WORD = r"[\p{L}\p{N}]+"


def nfkc(df: DataFrame, *columns: str) -> DataFrame:
    """Normalise string columns; the one step that needs Python, over Arrow batches."""
    import unicodedata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [
                pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in batch.column(c).to_pylist()], pa.string()) if c in columns else batch.column(c)
                for c in batch.schema.names
            ]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return df.mapInArrow(run, df.schema)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used, also within lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order: what sparse retrieval indexes. Cut at what isn't WORD, which takes less than to find each."""
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9\p{L}\p{N}]+"), "")


def normal(text: Column) -> Column:
    """Two abbreviations written out and white space collapsed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iU)\bTC\b", "tín chỉ")
    t = F.regexp_replace(t, r"(?iU)\bCTĐT\b", "chương trình đào tạo")
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))


def folded(text: Column) -> Column:
    """Lower case that also equates sharp s with ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def match_form(text: Column) -> Column:
    return folded(normal(text))


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Words of the normal text, case-folded, without stopwords and single characters."""
    found = F.regexp_extract_all(folded(normal(text)), F.lit(WORD), F.lit(0))
    if keep_stopwords:
        return found
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda t: (F.char_length(t) > 1) & ~F.array_contains(stop, t))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def contains_text(haystack: Column, needle: Column) -> Column:
    return (F.char_length(F.coalesce(needle, F.lit(""))) > 0) & F.contains(match_form(haystack), match_form(needle))


def sentences(text: Column) -> Column:
    """Sentences of a text; a long one without any end is cut at semicolons and commas. A blank text has none."""

    def cut(compact: Column) -> Column:
        parts = F.transform(F.filter(F.split(compact, r"(?<=[.!?])\s+"), lambda p: F.btrim(p) != ""), lambda p: F.btrim(p, F.lit(" -•\t")))
        pieces = F.filter(F.transform(F.split(compact, r";\s+|,\s+(?=[A-Z0-9])"), F.btrim), lambda p: p != "")
        chosen = let(parts, lambda p: F.when((F.size(p) <= 1) & (F.char_length(compact) > 260), pieces).otherwise(p))
        whole = let(chosen, lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(compact)))
        return F.when(compact == "", F.array().cast("array<string>")).otherwise(whole)

    return let(normal(text), cut)


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many elements two arrays share, counted with repeats."""

    def count(x: Column, y: Column) -> Column:
        shared = lambda t: F.least(F.size(F.filter(x, lambda u: u == t)), F.size(F.filter(y, lambda u: u == t)))
        return F.aggregate(F.transform(F.array_intersect(x, y), shared), F.lit(0), lambda s, n: s + n)

    return let(a, lambda x: let(b, lambda y: count(x, y)))


def token_f1(prediction: Column, gold: Column) -> Column:
    def score(p: Column, g: Column) -> Column:
        return let(
            multiset_overlap(p, g),
            lambda common: F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0))
            .when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), F.lit(0.0))
            .otherwise(2.0 * common / (F.size(p) + F.size(g))),
        )

    return let(tokens(prediction), lambda p: let(tokens(gold), lambda g: score(p, g)))


def inline(text: Column) -> Column:
    """One line: no-break spaces and soft hyphens resolved, a space behind bullets, white space collapsed."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    t = F.replace(F.replace(t, F.lit("­"), F.lit("")), F.lit("•"), F.lit("• "))
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))


def matching_form(text: Column) -> Column:
    return F.lower(inline(text))


def snippet(text: Column, most: int = 320) -> Column:
    compact = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.char_length(compact) <= most, compact).otherwise(F.concat(F.rtrim(F.substr(compact, F.lit(1), F.lit(most - 1))), F.lit("...")))


def char_count(text: Column, kind: str) -> Column:
    """How many characters of a class a text has, by how much shorter it is without them: no list of matches is made."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"{kind}+", ""))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def is_accented(text: Column) -> Column:
    """Any character from à to ỹ in lower case, or đ: the planner's sign of Vietnamese."""
    return F.rlike(F.lower(text), F.lit("[à-ỹ]"))


def any_of(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def starts_with_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.startswith(text, F.lit(t))
    return found


def text_quality(text: Column) -> Column:
    """0 to 1: how much a page's text looks like text, from shares of characters and lines."""
    space = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what (?U)\s is; classes name ASCII first, as that is tested first
    strip = lambda x: F.regexp_replace(x, f"^[{space}]+|[{space}]+$", "")

    def of_lines(lines: Column) -> Column:
        k = F.greatest(F.size(lines), F.lit(1))
        longs = F.aggregate(F.transform(lines, F.char_length), F.lit(0).cast("long"), lambda s, x: s + x)
        share = lambda test: F.size(F.filter(lines, test)) / k
        return 0.15 * F.least(longs / k / 40.0, F.lit(1.0)) - 0.40 * share(lambda x: F.char_length(x) <= 5) - 0.30 * share(lambda x: F.char_length(x) == 1)

    def of_text(t: Column) -> Column:
        return F.when(t == "", F.lit(0.0)).otherwise(let(F.char_length(t), lambda n: of_chars(t, n)))

    def of_chars(t: Column, n: Column) -> Column:
        share = lambda kind: (n - F.char_length(F.regexp_replace(t, f"{kind}+", ""))) / n
        lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip), lambda x: x != "")
        score = (
            0.25 * share(r"[ -~[^\p{C}\p{Zl}\p{Zp}\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]]")
            + 0.25 * share(r"[a-zA-Z0-9\p{L}\p{N}]")
            + 0.10 * F.least(share(f"[{space}]") / 0.15, F.lit(1.0))
            - 0.30 * share(r"[@#$%^&*_+=~`|<>\[\]{}]")
            - 0.50 * F.least(share(r"\?") * 10, F.lit(0.5))
            - 0.20 * F.least(share("[qxwvQXWV]") * 5, F.lit(0.2))
            + let(lines, of_lines)
        )
        return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))

    return let(strip(F.coalesce(text, F.lit(""))), of_text)
