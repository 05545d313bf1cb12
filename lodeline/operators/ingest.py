"""From raw text blocks to clean blocks, heading structure and chunks.

Blocks have the columns doc_id, page_index, reading_order, block_id, block_type
and text, and y0 and y1 where a layout is known. Whole documents are folded as
arrays of blocks within a row, so that no step but the gathering shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators.retrieval import small
from lodeline.sources.staging import staged

#: Names of numbered parts of legal texts, and keys of metadata lines.
LEGAL_PARTS = "chương|phần|mục|điều|khoản|điểm"
METADATA_KEYS = ("tên học phần", "mã học phần", "giảng viên", "email", "thời gian", "địa chỉ", "số điện thoại", "hạn nộp hồ sơ", "ngôn ngữ", "phiên bản")
_LEGAL = rf"(?iu)^({LEGAL_PARTS})\s+[0-9a-z]+[.:\-]?\s*"
_LIST = r"(?U)^(\d+[.)]|[a-zA-Z][.)]|[ivxlcdmIVXLCDM]+[.)]|[•●▪■*-])\s+\S+"
_BARE_NUMBER = r"(?U)^\d+\s+\S+"
_NUMBERED = r"(?U)^\d+(\.\d+)*\.?\s+\S+"
#: Types that a block keeps whatever its text is.
KEPT_TYPES = ("table", "image", "figure")


def upper_share(t: Column) -> Column:
    return X.let(X.char_count(t, r"\p{L}"), lambda letters: F.when(letters > 0, X.char_count(t, r"\p{Lu}") / letters).otherwise(0.0))


def is_heading(text: Column) -> Column:
    t = F.btrim(text)
    n = X.word_count(t)
    title = (n <= 10) & ~F.endswith(t, F.lit(".")) & ~F.endswith(t, F.lit(";")) & ~F.contains(t, F.lit(":")) & (F.char_length(t) <= 100)
    return (
        F.when(F.char_length(t) > 180, False)
        .when(F.rlike(t, F.lit(_LEGAL)), True)
        .when(F.rlike(t, F.lit(_NUMBERED)), ~F.rlike(t, F.lit(_BARE_NUMBER)))
        .when((upper_share(t) > 0.85) & (n <= 12), True)
        .otherwise(title)
    )


def is_list_item(text: Column) -> Column:
    t = F.btrim(text)
    return F.rlike(t, F.lit(_LIST)) | F.rlike(t, F.lit(_BARE_NUMBER))


def is_metadata(text: Column) -> Column:
    t = F.btrim(text)
    return F.rlike(t, F.lit(r"(?U)^[^:\n]{1,80}:\s+\S+")) | X.starts_with_any(F.lower(F.substr(t, F.lit(1), F.lit(40))), tuple(k + ":" for k in METADATA_KEYS))


def block_type(text: Column, given: Column) -> Column:
    return (
        F.when(F.btrim(text) == "", "paragraph")
        .when(given.isin(*KEPT_TYPES), given)
        .when(is_heading(text), "heading")
        .when(is_list_item(text), "list_item")
        .when(is_metadata(text), "metadata")
        .otherwise("paragraph")
    )


def item_number(text: Column) -> Column:
    t = F.btrim(text)
    first = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    part = rf"(?iu)^(khoản|điểm)\s+([0-9a-z]+)\b"
    return F.coalesce(
        first(r"(?U)^(\d+(?:\.\d+)*\.?)\s+\S+"), first(r"^([a-zA-Z][.)])\s+\S+"), first(r"^([ivxlcdmIVXLCDM]+[.)])\s+\S+"), first(r"^([•●▪■*-])\s+\S+"),
        F.when(F.rlike(t, F.lit(part)), F.concat_ws(" ", F.regexp_extract(t, part, 1), F.regexp_extract(t, part, 2))),
    )


def without_marker(text: Column) -> Column:
    t = F.btrim(text)
    out = t
    for pattern in reversed((r"^\d+[.)]\s+", r"^[a-zA-Z][.)]\s+", r"^[ivxlcdmIVXLCDM]+[.)]\s+", r"^[•●▪■*-]\s+", r"^\d+\s+")):
        out = F.when(F.rlike(t, F.lit(pattern)), F.regexp_replace(t, pattern, "")).otherwise(out)
    return out


def markdown(text: Column, kind: Column) -> Column:
    shown = lambda t: F.when(t == "", "").when(kind == "heading", F.concat(F.lit("## "), t)).when(kind == "list_item", F.concat(F.lit("- "), without_marker(t))).otherwise(t)
    return X.let(X.inline(text), shown)


def is_noise(text: Column) -> Column:
    t = F.btrim(text)
    shout = (F.char_length(t) <= 12) & (upper_share(t) >= 0.95) & (X.word_count(t) <= 3) & ~F.rlike(t, F.lit(_LEGAL))
    return (t == "") | F.rlike(t, F.lit(r"(?U)^\d{1,3}$")) | ((F.char_length(t) == 1) & ~F.rlike(t, F.lit(r"[\p{L}\p{N}]"))) | shout


def line_blocks(documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each line of a text that isn't blank as a paragraph; ids count all lines."""
    lines = documents.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("reading_order", "text"))
    return lines.where(F.btrim("text") != "").select(
        "doc_id", F.lit(0).alias("page_index"), "reading_order", F.format_string("p%04d_b%04d", F.lit(0), F.col("reading_order")).alias("block_id"),
        F.lit("paragraph").alias("block_type"), "text", F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"),
    )


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of raw HTML, in order, without inner tags."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li)>"), F.lit(0))).alias("reading_order", "raw"))
    kind = F.regexp_extract("raw", r"^<(h[1-6]|p|li)", 1)
    text = F.btrim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return found.select(
        F.col("page_id").alias("doc_id"), F.lit(0).alias("page_index"), "reading_order",
        F.when(F.startswith(kind, F.lit("h")), "heading").when(kind == "li", "list_item").otherwise("paragraph").alias("block_type"),
        F.when(F.startswith(kind, F.lit("h")), F.substr(kind, F.lit(2)).cast("int")).alias("level"), text.alias("text"),
    ).where("text <> ''")


def repeated_texts(blocks: DataFrame, min_pages: int = 3, ratio: float = 0.6, longest: int = 220) -> DataFrame:
    """(doc_id, norm, pages, edge_hits) of short texts on many pages of a document, or on some, near an edge.

    Only documents with enough pages are looked through.
    """
    totals = staged(blocks.sparkSession, blocks.groupBy("doc_id").agg(F.countDistinct("page_index").alias("all_pages")).where(F.col("all_pages") >= min_pages), "pages")
    shaped = blocks.join(small(totals.select("doc_id")), "doc_id", "left_semi").select("doc_id", "page_index", X.matching_form(F.col("text")).alias("norm"), F.coalesce((F.col("y0") < 90) | (F.col("y1") > 720), F.lit(False)).alias("edge"))
    counted = shaped.where((F.col("norm") != "") & (F.char_length("norm") <= longest)).groupBy("doc_id", "norm").agg(
        F.countDistinct("page_index").alias("pages"), F.sum(F.col("edge").cast("long")).alias("edge_hits")
    )
    often = (F.col("pages") / F.col("all_pages") >= ratio) | (F.col("edge_hits") >= max(2, min_pages - 1))
    return counted.where(F.col("pages") >= min_pages).join(totals, "doc_id").where(often).select("doc_id", "norm", "pages", "edge_hits")


def without_repeated(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    shaped = blocks.withColumn("norm", X.matching_form(F.col("text")))
    return shaped.join(repeated.select("doc_id", "norm"), ["doc_id", "norm"], "left_anti").drop("norm")


def normalised(blocks: DataFrame) -> DataFrame:
    """Inline text, inferred type, item number and Markdown; noise goes.

    All of a block is made in one expression, so that no filter on it is
    pushed below it and makes it again for each place where it is used.
    """
    more = lambda t, kind: F.struct(t.alias("text"), kind.alias("block_type"), item_number(t).alias("item_number"), markdown(t, kind).alias("markdown"))
    one = lambda t: F.when(~is_noise(t), X.let(block_type(t, F.col("block_type")), lambda kind: more(t, kind)))
    made = blocks.select("*", F.explode(F.array_compact(F.array(X.let(X.inline(F.col("text")), one)))).alias("made"))
    return made.select(*(F.col(f"made.{c}").alias(c) if c in ("text", "block_type") else F.col(c) for c in blocks.columns), "made.item_number", "made.markdown")


def _join(left: Column, right: Column) -> Column:
    first = F.substr(right, F.lit(1), F.lit(1))
    hyphen = F.endswith(left, F.lit("-")) & F.rlike(first, F.lit(r"^\p{Ll}"))
    return F.when(left == "", right).when(right == "", left).when(hyphen, F.concat(F.substr(left, F.lit(1), F.char_length(left) - 1), right)).otherwise(F.concat_ws(" ", left, right))


def _goes_on(left: Column, right: Column) -> Column:
    lt, rt = F.btrim(left["text"]), F.btrim(right["text"])
    open_end = ~F.rlike(F.right(lt, F.lit(3)), F.lit(r"[.!?;:]$")) | F.rlike(rt, F.lit(r"^\p{Ll}"))
    plain = ~is_metadata(lt) & ~is_metadata(rt) & ~is_heading(lt) & ~is_heading(rt) & ~is_list_item(lt) & ~is_list_item(rt)
    return (left["page_index"] == right["page_index"]) & (left["block_type"] == "paragraph") & (right["block_type"] == "paragraph") & open_end & plain


def gathered(blocks: DataFrame) -> DataFrame:
    """(doc_id, blocks): a document's blocks in reading order, one row a document."""
    fields = F.struct(F.col("page_index").cast("int").alias("page_index"), F.col("reading_order").cast("int").alias("reading_order"), "block_id", "block_type", "text")
    return blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(fields)).alias("blocks"))


_MERGED = "array<struct<page_index:int,reading_order:int,block_type:string,text:string,block_ids:array<string>>>"


def merged(documents: DataFrame) -> DataFrame:
    """Paragraphs that go on in the next block become one. Each step looks at the text joined so far."""
    empty = F.array().cast(_MERGED)
    item = lambda b, i, ids: F.struct(b["page_index"].alias("page_index"), i.alias("reading_order"), b["block_type"].alias("block_type"), b["text"].alias("text"), ids.alias("block_ids"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        single = item(b, F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["page_index"] == b["page_index"]), F.try_element_at(done, F.lit(-1))["reading_order"] + 1).otherwise(0), F.array(b["block_id"]))
        longer = F.struct(
            last["page_index"].alias("page_index"), last["reading_order"].alias("reading_order"), last["block_type"].alias("block_type"),
            _join(last["text"], b["text"]).alias("text"), F.concat(last["block_ids"], F.array(b["block_id"])).alias("block_ids"),
        )
        return (
            F.when(F.size(done) == 0, F.array(single))
            .when(_goes_on(last, b), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))
            .otherwise(F.concat(done, F.array(single)))
            .cast(_MERGED)
        )

    return documents.withColumn("blocks", F.aggregate("blocks", empty, step))


def heading_level(text: Column) -> Column:
    t = F.btrim(text)
    return F.when(F.rlike(t, F.lit(r"(?U)^\d+\.\d+\.\d+")), 3).when(F.rlike(t, F.lit(r"(?U)^\d+\.\d+")), 2).otherwise(1)


_STRUCTURED = "array<struct<page_index:int,reading_order:int,block_type:string,text:string,block_ids:array<string>,level:int,heading_path:array<string>,item_number:string>>"


def structured(documents: DataFrame) -> DataFrame:
    """Heading paths. A heading of level n cuts the path to n - 1 entries, whatever their levels are, and is appended."""
    state = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast(_STRUCTURED).alias("out"))

    def step(s: Column, b: Column) -> Column:
        heading = b["block_type"] == "heading"
        level = F.when(heading, heading_level(b["text"]))
        path = F.when(heading, F.concat(F.slice(s["path"], 1, F.least(F.size(s["path"]), level - 1)), F.array(F.btrim(b["text"])))).otherwise(s["path"])
        number = F.nullif(F.regexp_extract(F.btrim(b["text"]), r"(?U)^(\d+(?:\.\d+)*)(?:[.)]|\s)", 1), F.lit(""))
        fields = [b[f].alias(f) for f in ("page_index", "reading_order", "block_type", "text", "block_ids")]
        one = F.struct(*fields, level.alias("level"), path.alias("heading_path"), number.alias("item_number"))
        return F.struct(path.alias("path"), F.concat(s["out"], F.array(one)).cast(_STRUCTURED).alias("out"))

    return documents.withColumn("blocks", F.aggregate("blocks", state, step)["out"])


_CHUNKS = "array<struct<text:string,chars:int,open:boolean,is_table:boolean,heading_path:array<string>,pages:array<int>,block_ids:array<string>,block_types:array<string>>>"


def chunks(documents: DataFrame, max_chars: int = 1200) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, text, ...) of a document's structured blocks.

    A heading, a table or too many characters close a chunk; no block is
    split, and a table is a chunk of its own.
    """
    empty = F.array().cast(_CHUNKS)

    def step(done: Column, b: Column) -> Column:
        t = F.btrim(b["text"])
        n = F.char_length(t)
        table, last = b["block_type"] == "table", F.try_element_at(done, F.lit(-1))
        fresh = F.struct(
            t.alias("text"), n.alias("chars"), (~table).alias("open"), table.alias("is_table"), b["heading_path"].alias("heading_path"),
            F.array(b["page_index"]).alias("pages"), b["block_ids"].alias("block_ids"), F.array(b["block_type"]).alias("block_types"),
        )
        longer = F.struct(
            F.concat_ws("\n", last["text"], t).alias("text"), (last["chars"] + n).alias("chars"), F.lit(True).alias("open"), F.lit(False).alias("is_table"), last["heading_path"].alias("heading_path"),
            F.concat(last["pages"], F.array(b["page_index"])).alias("pages"), F.concat(last["block_ids"], b["block_ids"]).alias("block_ids"), F.concat(last["block_types"], F.array(b["block_type"])).alias("block_types"),
        )
        alone = (F.size(done) == 0) | table | (b["block_type"] == "heading") | ~F.coalesce(last["open"], F.lit(False)) | (last["chars"] + n > max_chars)
        return F.when(t == "", done).when(alone, F.concat(done, F.array(fresh))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).cast(_CHUNKS)

    made = documents.select("doc_id", F.posexplode(F.aggregate("blocks", empty, step)).alias("chunk_index", "c"))
    return made.select(
        "doc_id", "chunk_index", F.format_string("chunk_%05d", F.col("chunk_index")).alias("chunk_id"), "c.text", "c.heading_path",
        F.element_at("c.pages", 1).alias("page_start"), F.element_at("c.pages", -1).alias("page_end"), F.array_sort(F.array_distinct("c.pages")).alias("page_indices"),
        "c.block_ids", "c.block_types", F.col("c.is_table").alias("is_table_chunk"),
    )


def clean(blocks: DataFrame) -> DataFrame:
    """Repeated headers and footers, noise and broken paragraphs resolved: (doc_id, blocks)."""
    repeated = staged(blocks.sparkSession, repeated_texts(blocks), "repeated")
    return merged(gathered(normalised(without_repeated(blocks, small(repeated)))))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_index", "block_type").agg(F.count("*").alias("blocks"))


def primary_block_type(types: Column, is_table: Column) -> Column:
    out = F.element_at(types, 1)
    for kind in reversed(("paragraph", "list_item", "list", "metadata", "caption", "figure")):
        out = F.when(F.array_contains(types, kind), kind).otherwise(out)
    return F.when(F.coalesce(is_table, F.lit(False)) | F.array_contains(types, "table"), "table").when(F.size(types) > 0, out).otherwise("paragraph")


def corpus_of(made: DataFrame, source: str) -> DataFrame:
    """Chunks as a retrieval corpus; positions follow documents and chunks."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    first = made.groupBy("doc_id").agg(F.count("*").alias("n"))
    starts = first.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return made.withColumn("at", F.row_number().over(order) - 1).join(starts, "doc_id").select(
        (F.col("start") + F.col("at")).alias("chunk_idx"), F.concat(F.lit(source + ":"), F.col("doc_id").cast("string"), F.lit(":"), F.col("chunk_id")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(source).alias("source_name"), "text", "heading_path", F.try_element_at("heading_path", F.lit(-1)).alias("section"),
        (F.col("page_start") + 1).alias("page"), primary_block_type(F.col("block_types"), F.col("is_table_chunk")).alias("block_type"),
    )


def probe(pages: DataFrame) -> DataFrame:
    """A document's mode (text, layout, ocr or mixed) from its pages (doc_id, page_index, text, block_count, image_count)."""
    chars, images = F.char_length(F.coalesce("text", F.lit(""))), F.col("image_count")
    shaped = pages.withColumn("chars", chars).withColumn("quality", X.text_quality(F.col("text")))
    scanned = ((images >= 1) & (F.col("chars") < 80)) | ((images >= 1) & (F.col("quality") < 0.35)) | ((F.col("chars") < 20) & (F.col("block_count") <= 3))
    n = F.greatest(F.count("*"), F.lit(1))
    each = shaped.groupBy("doc_id").agg(
        F.count("*").alias("page_count"), F.sum("chars").alias("total_chars"), F.sum("block_count").alias("total_blocks"), F.sum("image_count").alias("total_images"),
        (F.sum("chars") / n).alias("avg_chars_per_page"), (F.sum("block_count") / n).alias("avg_blocks_per_page"), (F.sum("image_count") / n).alias("avg_images_per_page"),
        (F.count_if(F.col("chars") > 50) / n).alias("text_layer_ratio"), (F.count_if(F.col("chars") <= 50) / n).alias("empty_text_ratio"),
        (F.count_if(scanned) / n).alias("likely_scanned_ratio"), (F.count_if((images >= 1) & (F.col("block_count") <= 10)) / n).alias("image_heavy_ratio"), F.avg("quality").alias("avg_text_quality"),
    )
    scan, layer = F.col("likely_scanned_ratio"), F.col("text_layer_ratio")
    mode = (
        F.when((scan >= 0.8) & (layer < 0.3), "ocr")
        .when((F.col("avg_chars_per_page") < 40) & (F.col("avg_images_per_page") >= 1), "ocr")
        .when((scan >= 0.4) & (layer >= 0.3), "mixed")
        .when((F.col("image_heavy_ratio") >= 0.4) & (F.col("avg_text_quality") < 0.45), "mixed")
        .when((layer >= 0.7) & (F.col("avg_blocks_per_page") >= 12), "layout")
        .otherwise("text")
    )
    return each.withColumn("mode", mode)
