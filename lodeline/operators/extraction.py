"""How a document gets its blocks: markdown, the plan of extractors, the test of their results, region routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types that stay as they are, then parts of names and the type each stands for, the first that fits.
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table", "caption", "figure", "metadata")
TYPE_PARTS = (("title", "heading"), ("header", "heading"), ("list", "list_item"), ("table", "table"), ("caption", "caption"), ("figure", "figure"), ("image", "figure"), ("meta", "metadata"))
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def normal_block_type(kind: Column) -> Column:
    """One of BLOCK_TYPES for any name; a paragraph if none fits."""
    name = F.lower(F.coalesce(kind, F.lit("")))
    found = F.lit("paragraph")
    for part, block_type in reversed(TYPE_PARTS):
        found = F.when(F.contains(name, F.lit(part)), block_type).otherwise(found)
    return F.when(name.isin(*BLOCK_TYPES), name).otherwise(found)


def normal_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, position, block_type, text, markdown, reading_order) without gaps: the type's name, the text as markdown, the position as order."""
    return blocks.select(
        *(c for c in blocks.columns if c not in ("block_type", "markdown", "reading_order")),
        normal_block_type(F.col("block_type")).alias("block_type"), F.coalesce("markdown", "text").alias("markdown"), F.coalesce("reading_order", "position").alias("reading_order"),
    )


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, reading_order, block_type, level, text) of the markdown of ``docs`` (doc_id, markdown).

    Headings and list items are lines; a table is a line with a bar before a
    rule, and all lines with bars that follow; other lines up to a blank one
    or one of these are a paragraph. Lines are told apart by windows over a
    document, whose lines are sorted once.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), LINE_END)).alias("line", "raw")).withColumn("s", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    w = Window.partitionBy("doc_id").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    bar, s = F.contains("s", F.lit("|")), F.col("s")
    after = F.lead("s").over(w)
    rule = F.contains(after, F.lit("|")) & F.contains(after, F.lit("-")) & F.rlike(after, F.lit(r"^[|:\- ]*$"))
    kinds = lines.select(
        "doc_id", "line", "s", F.regexp_replace("raw", r"\s+$", "").alias("raw"), bar.alias("bar"), F.rlike(s, F.lit(r"^#{1,6}\s+")).alias("heading"), F.rlike(s, F.lit(r"^[-*+]\s+")).alias("item"),
        (bar & F.coalesce(rule, F.lit(False))).alias("opens"), F.sum(F.when(~bar, 1).otherwise(0)).over(upto).alias("run"),
    )
    start = F.min(F.when(F.col("opens") & ~F.col("heading") & ~F.col("item"), F.col("line"))).over(Window.partitionBy("doc_id", "run"))
    marked = kinds.withColumn("table", F.col("bar") & F.coalesce(F.col("line") >= start, F.lit(False)))
    kind = F.when(F.col("table"), "table").when(s == "", "blank").when(F.col("heading"), "heading").when(F.col("item"), "list_item").otherwise("paragraph")
    typed = marked.withColumn("kind", kind)
    alone = F.col("kind").isin("blank", "heading", "list_item") | (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))) | (F.col("table") & (F.col("run") != F.lag("run").over(w)))
    grouped = typed.withColumn("block", F.sum(F.when(alone, 1).otherwise(0)).over(upto)).where("kind <> 'blank'")
    joined = grouped.groupBy("doc_id", "block", "kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n").alias("whole"))
    text = F.regexp_replace(F.col("whole"), r"^\s+|\s+$", "")
    plain = F.when(F.col("kind") == "heading", F.regexp_replace(text, r"^#{1,6}\s+", "")).when(F.col("kind") == "list_item", F.regexp_replace(text, r"^[-*+]\s+", "")).otherwise(text)
    level = F.when(F.col("kind") == "heading", F.char_length(F.regexp_extract(text, r"^(#{1,6})", 1)))
    order = (F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1).alias("reading_order")
    return joined.select("doc_id", order, F.col("kind").alias("block_type"), level.alias("level"), plain.alias("text"))


def skips_layout(probe: dict[str, Column], forced: bool = False) -> Column:
    """Whether a document is so much of a scan that the layout extractor isn't tried."""
    scanned = (probe["likely_scanned_ratio"] >= 0.8) & (probe["text_layer_ratio"] < 0.25) & (probe["avg_images_per_page"] >= 1.0)  # fixed values
    return F.lit(False) if forced else (probe["mode"] == "ocr") & scanned


def prefers_layout(probe: dict[str, Column], routed: bool) -> Column:
    """Whether routed regions come before recognition for a document of page images."""
    pictures = (probe["avg_images_per_page"] >= 1.0) & (probe["text_layer_ratio"] < 0.25) & (probe["image_heavy_ratio"] >= 0.5)  # fixed values
    return pictures & F.lit(routed)


def extractor_plan(probe: dict[str, Column], model: bool = False, routed: bool = False, forced: bool = False) -> Column:
    """The names of the extractors to try, in order, from a document's probe (see ``ingest.probe``)."""
    models = (["model_routed"] if routed else []) + ["model_layout"] if model else []
    none = F.array().cast("array<string>")
    layouts = F.concat(F.array(*map(F.lit, models)) if models else none, F.when(skips_layout(probe, forced), none).otherwise(F.array(F.lit("layout"))))
    text, ocr, mode = F.array(F.lit("text")), F.array(F.lit("ocr")), probe["mode"]
    first = prefers_layout(probe, model and routed)
    return (
        F.when((mode == "ocr") & first, F.concat(layouts, ocr, text))
        .when(mode == "ocr", F.concat(ocr, text, layouts))
        .when((mode == "layout") | ((mode == "mixed") & first), F.concat(layouts, text, ocr))
        .otherwise(F.concat(text, layouts, ocr))
    )


def valid_results(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, extractor, valid) of each extractor's ``pages`` (doc_id, extractor) and ``blocks`` (doc_id, extractor, block_type, text, has_bbox, route).

    A result of layout needs more blocks than pages, and either other types
    than paragraphs or five blocks; one of a model needs boxes too, and one of
    routed regions their routes. Text needs fifty characters, recognition one
    block that isn't blank. What has no page or no block isn't valid.
    """
    key = ["doc_id", "extractor"]
    text = F.coalesce("text", F.lit(""))
    found = blocks.groupBy(key).agg(
        F.count("*").alias("blocks"), F.count_if(F.coalesce("block_type", F.lit("")) != "paragraph").alias("other"), F.count_if("has_bbox").alias("boxes"),
        F.count("route").alias("routes"), F.sum(F.char_length(text)).alias("chars"), F.count_if(F.rlike(text, F.lit(r"\S"))).alias("inked"),
    )
    both = pages.groupBy(key).agg(F.count("*").alias("pages")).join(found, key, "left")
    name = F.col("extractor")
    layout = (F.col("blocks") > F.col("pages")) & ((F.col("other") > 0) | (F.col("blocks") >= 5))
    valid = (
        F.when(name == "layout", layout).when(name == "model_layout", layout & (F.col("boxes") > 0)).when(name == "model_routed", layout & (F.col("boxes") > 0) & (F.col("routes") > 0))
        .when(name == "text", F.col("chars") >= 50).when(name == "ocr", F.col("inked") > 0).otherwise(F.col("blocks") > 0)
    )
    return both.select(*key, F.coalesce(valid, F.lit(False)).alias("valid"))


def chosen_extractors(plans: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, extractor, tried): the first of each document's ``plan`` whose result is valid, null if none is; and the failed ones before it."""
    steps = plans.select("doc_id", F.posexplode("plan").alias("step", "extractor")).join(results, ["doc_id", "extractor"], "left")
    ok = F.coalesce("valid", F.lit(False))
    best = steps.groupBy("doc_id").agg(F.min_by("extractor", F.when(ok, F.col("step"))).alias("extractor"), F.min(F.when(ok, F.col("step"))).alias("at"), F.count("*").alias("steps"))
    return best.select("doc_id", F.when(F.col("at").isNotNull(), F.col("extractor")).alias("extractor"), F.coalesce("at", "steps").cast("int").alias("tried"))


def region_route(block_type: Column, direct_text: Column) -> Column:
    """Where a region's text comes from: table, text, ocr or placeholder."""
    kind, has_text = F.lower(F.btrim(F.coalesce(block_type, F.lit("")))), F.rlike(F.coalesce(direct_text, F.lit("")), F.lit(r"\S"))
    return F.when(kind == "table", "table").when(has_text, "text").when(kind == "figure", "placeholder").otherwise("ocr")
