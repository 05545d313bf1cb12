"""Lines that a text recogniser found on scanned pages: filter, type, and gather those that look like a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import text as X

#: Least confidence of a line; least lines of a page and of a cluster; least shares of a page's width and height.
CONFIDENT, PAGE_LINES, CLUSTER_LINES, WIDE, HIGH = 0.5, 6, 4, 0.45, 0.18
#: A cluster is a table if one of these shares is reached: of digits, of rows with two numbers, of short or numbered rows.
DIGITS, NUMERIC, STRUCTURED = 0.10, 0.35, 0.65
#: Lines, share of structured rows and share of the height that make a page without such a cluster a table as a whole.
WHOLE_LINES, WHOLE_STRUCTURED, WHOLE_HIGH = 20, 0.7, 0.2

_PAGE = ("doc_id", "page_index")


def line_type(text: Column) -> Column:
    """list_item, heading or paragraph, by a line's first signs and capitals."""
    s = F.btrim(F.coalesce(text, F.lit("")))
    capitals = (F.upper(s) == s) & (F.lower(s) != s)
    return (
        F.when(X.starts_with_any(s, ("- ", "* ", "• ")), "list_item")
        .when((F.char_length(s) > 0) & (F.char_length(s) < 100) & (capitals | X.starts_with_any(s, ("1.", "2.", "3.", "4.", "5."))), "heading")
        .otherwise("paragraph")
    )


def digit_share(text: Column) -> Column:
    """Digits among a text's letters and numbers; 0.0 if it has none."""
    known = F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))
    return F.when(known > 0, F.regexp_count(text, F.lit(r"\p{Nd}")) / known).otherwise(0.0)


def is_numeric_row(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)?")) >= 2


def is_structured_row(text: Column) -> Column:
    """One to three words, or up to eight with a number among them."""
    n = X.word_count(text)
    return (n > 0) & ((n <= 3) | ((n <= 8) & F.rlike(text, F.lit(r"(?U)\b\d+(?:[.,]\d+)?\b"))))


def confident(lines: DataFrame) -> DataFrame:
    """Lines with text whose score is unknown or good enough."""
    return lines.where((F.btrim(F.coalesce("text", F.lit(""))) != "") & (F.col("score").isNull() | (F.col("score") >= CONFIDENT)))


def table_blocks(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """The best table-like group of lines of each page, if there is one.

    ``lines``: doc_id, page_index, line, text, score, bbox (x0, y0, x1, y1).
    ``pages``: doc_id, page_index, width, height. A vertical gap of over 1.8
    times the median height, 6 at least, begins a group. Lines without a box
    are left out, null texts are empty, and sizes below 1 count as 1. Of equal
    groups the upper one wins. Returns doc_id, page_index, text, bbox,
    confidence (null if unknown) and n_lines. All windows and aggregates share
    one shuffle by page; a page's lines are few.
    """
    page = Window.partitionBy(*_PAGE)
    order = page.orderBy(F.col("bbox.y0"), F.col("bbox.x0"), F.col("line"), F.col("text"))
    kept = lines.where("bbox is not null").select(*_PAGE, "line", F.coalesce("text", F.lit("")).alias("text"), "score", "bbox")
    kept = kept.join(pages.select(*_PAGE, F.greatest("width", F.lit(1.0)).alias("width"), F.greatest("height", F.lit(1.0)).alias("height")), list(_PAGE))
    gap = F.col("bbox.y0") - F.lag("bbox.y1").over(order)
    kept = kept.select(
        "*", gap.alias("gap"), F.row_number().over(order).alias("nth"), F.count("*").over(page).alias("total"),
        F.median(F.greatest(F.lit(1.0), F.col("bbox.y1") - F.col("bbox.y0"))).over(page).alias("line_height"),
        (line_type(F.col("text")).isin("heading", "list_item") | is_structured_row(F.col("text"))).cast("double").alias("structured"),
    )
    kept = kept.where(F.col("total") >= PAGE_LINES).withColumn("page_structured", F.avg("structured").over(page))
    far = F.coalesce(F.col("gap") > F.greatest(F.lit(6.0), F.col("line_height") * 1.8), F.lit(False))
    kept = kept.withColumn("cluster", F.sum(far.cast("int")).over(order))

    def gathered(df: DataFrame, *keys: str) -> DataFrame:
        box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))
        found = df.groupBy(*_PAGE, *keys).agg(
            F.count("*").alias("n_lines"), F.first("total").alias("total"), box.alias("bbox"), F.first("width").alias("width"), F.first("height").alias("height"),
            F.avg(digit_share(F.col("text"))).alias("digits"), F.avg(is_numeric_row(F.col("text")).cast("double")).alias("numeric"), F.avg("structured").alias("structured"),
            F.avg("score").alias("confidence"), F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("texts"),
        )
        found = found.withColumn("wide", (F.col("bbox.x1") - F.col("bbox.x0")) / F.col("width")).withColumn("high", (F.col("bbox.y1") - F.col("bbox.y0")) / F.col("height"))
        return found.where(F.col("wide") >= WIDE)

    alike = (F.col("digits") >= DIGITS) | (F.col("numeric") >= NUMERIC) | (F.col("structured") >= STRUCTURED)
    rated = 0.5 * F.col("n_lines") + 12.0 * F.col("digits") + 10.0 * F.col("numeric") + 8.0 * F.col("structured") + 2.0 * F.col("wide") + 4.0 * F.col("n_lines") / F.col("total")
    groups = gathered(kept, "cluster").where((F.col("n_lines") >= CLUSTER_LINES) & (F.col("high") >= HIGH) & alike).withColumn("rated", rated)
    inner = kept.where((F.col("total") >= WHOLE_LINES) & (F.col("page_structured") >= WHOLE_STRUCTURED) & F.col("nth").between(F.lit(3), F.col("total") - 2))
    whole = gathered(inner).where(F.col("high") >= WHOLE_HIGH).withColumn("cluster", F.lit(-1).cast("long")).withColumn("rated", F.lit(-1.0))
    best = page.orderBy(F.desc(F.round("rated", 9)), "cluster")
    either = groups.unionByName(whole).withColumn("place", F.row_number().over(best)).where("place = 1")
    return either.select(*_PAGE, F.btrim(F.array_join("texts", "\n")).alias("text"), "bbox", "confidence", "n_lines").where("text <> ''")
