"""Readers and writers of chunks, query cases, benchmark sets and reports. All reading is Spark's own, with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "chunk_id string, chunk_index int, text string, markdown string, doc_id string, source_name string, page int, page_start int, page_end int, page_indices array<int>, "
    "section string, title string, heading_path array<string>, block_type string, block_types array<string>, `order` int, version string, date string, metadata map<string,string>, meta map<string,string>"
)
CASE = (
    "query_id string, id string, question string, query string, query_type string, source_name string, doc_id string, expected_chunk_id string, expected_chunk_ids array<string>, "
    "expected_page int, expected_pages array<int>, expected_section string, section string, match_text string, gold_answer string, should_answer boolean, answerable boolean, expected_decision string"
)


def _items(spark: SparkSession, path: str, kind: str, key: str) -> DataFrame:
    """Rows of a JSON list, of an object that holds one under ``key``, or of JSON lines; blank lines are skipped."""
    whole = spark.read.text(path, wholetext=True).select(F.btrim("value").alias("v"))
    lists = whole.where(F.startswith("v", F.lit("["))).select(F.explode(F.from_json("v", f"array<struct<{_as_fields(kind)}>>")).alias("r"))
    held = whole.where(F.rlike("v", F.lit(rf'(?s)^\{{\s*"(?:[^"]|\\")*"\s*:')) & F.get_json_object("v", f"$.{key}").isNotNull())
    objects = held.select(F.explode(F.from_json(F.get_json_object("v", f"$.{key}"), f"array<struct<{_as_fields(kind)}>>")).alias("r"))
    if whole.where(F.startswith("v", F.lit("["))).limit(1).count():
        return lists.select("r.*")
    if held.limit(1).count():
        return objects.select("r.*")
    return spark.read.schema(kind).json(path).dropna("all")


def _as_fields(kind: str) -> str:
    depth, out = 0, ""
    for ch in kind:
        depth += (ch == "<") - (ch == ">")
        out += ch
    parts, now, depth = [], "", 0
    for ch in out + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, _, t = now.strip().partition(" ")
            parts.append(f"{name}:{t}")
            now = ""
        else:
            now += ch
    return ",".join(parts)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return canonical_chunks(_items(spark, path, CHUNK, "chunks"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    rows = _items(spark, path, CASE, "queries")
    answer = F.coalesce("should_answer", "answerable", F.when(F.col("expected_decision").isNotNull(), F.col("expected_decision") == "answer"), F.lit(True))
    pages = F.array_union(F.coalesce("expected_pages", F.array().cast("array<int>")), F.array_compact(F.array("expected_page")))
    return rows.withColumns({"query_id": F.coalesce("query_id", "id"), "query": F.coalesce("question", "query", F.lit("")), "should_answer": answer, "expected_pages": pages,
                             "expected_section": F.coalesce("expected_section", "section")}).drop("id", "question", "answerable", "section", "expected_page")


def _filled(c: str) -> Column:
    return F.nullif(F.btrim(c), F.lit(""))


def canonical_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of any of the known shapes in one: the page from page_start, the section from the headings. A chunk without id is an error."""
    meta = F.coalesce("metadata", "meta", F.create_map().cast("map<string,string>"))
    known = ("paragraph", "list_item", "list", "metadata", "caption", "figure")
    types = F.coalesce("block_types", F.array().cast("array<string>"))
    first = F.try_element_at(F.filter(F.array(*map(F.lit, known)), lambda k: F.array_contains(types, k)), F.lit(1))
    kind = F.when(F.lower(F.coalesce(meta["is_table_chunk"], F.lit(""))) == "true", "table").when(F.array_contains(types, "table"), "table").otherwise(
        F.coalesce(first, F.try_element_at(types, F.lit(1)), _filled("block_type"), F.lit("paragraph"))
    )
    source = F.coalesce(_filled("source_name"), meta["source_name"])
    return rows.select(
        F.when(_filled("chunk_id").isNull(), F.raise_error(F.lit("a chunk has no chunk_id"))).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.coalesce(F.nullif("text", F.lit("")), F.col("markdown"), F.lit("")).alias("text"), F.coalesce(_filled("doc_id"), meta["doc_id"], source).alias("doc_id"), source.alias("source_name"),
        F.coalesce(F.col("page"), F.col("page_start") + 1).alias("page"), "page_start", "page_end", F.coalesce("page_indices", F.array().cast("array<int>")).alias("page_indices"),
        F.coalesce(_filled("section"), meta["section"], F.try_element_at("heading_path", F.lit(-1))).alias("section"), _filled("title").alias("title"),
        F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"), kind.alias("block_type"), F.coalesce("order", "chunk_index").alias("order"),
        _filled("version").alias("version"), _filled("date").alias("date"), meta.alias("metadata"),
    )


def with_source(chunks: DataFrame, source: str) -> DataFrame:
    """Chunk ids that begin with their source's name."""
    named = F.when(F.startswith("chunk_id", F.lit(source + ":")), F.col("chunk_id")).otherwise(F.concat(F.lit(source + ":"), "chunk_id"))
    return chunks.withColumns({"chunk_id": named, "source_name": F.coalesce("source_name", F.lit(source)), "doc_id": F.coalesce("doc_id", F.lit(source))})


def read_ir_set(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv: (corpus, queries, gold), gold of positive relevance."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl")
    corpus = corpus.select(F.col("_id").alias("doc_id"), "title", F.col("title").alias("section"), F.btrim(F.concat_ws("\n", _filled("title"), "text")).alias("text"))
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), F.col("text").alias("query"))
    gold = spark.read.csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True, schema="query_id string, doc_id string, relevance int").where("relevance > 0")
    return corpus, queries, gold.select("query_id", "doc_id")


def read_coco(spark: SparkSession, path: str, classes: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """(images, regions) of a COCO file; boxes as corners, categories by number, others left out."""
    kind = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<image_id:long,category_id:int,bbox:array<double>>>"
    data = spark.read.schema(kind).json(path, multiLine=True)
    names = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    images = data.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    found = data.select(F.posexplode("annotations").alias("region", "a")).select("region", F.col("a.image_id").alias("image_id"), names[F.col("a.category_id")].alias("block_type"), F.col("a.bbox").alias("b"))
    box = F.struct(F.col("b")[0].alias("x0"), F.col("b")[1].alias("y0"), (F.col("b")[0] + F.col("b")[2]).alias("x1"), (F.col("b")[1] + F.col("b")[3]).alias("y1"))
    return images, found.where("block_type is not null").select("image_id", "region", "block_type", box.alias("bbox"))


def read_voc(spark: SparkSession, path: str, keep: str = "table") -> DataFrame:
    """Regions of VOC annotation files: (filename, width, height, region, block_type, bbox)."""
    kind = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(kind).load(path)
    found = rows.select("filename", "size.width", "size.height", F.posexplode("object").alias("region", "o")).where(F.col("o.name") == keep)
    box = F.struct(F.col("o.bndbox.xmin").alias("x0"), F.col("o.bndbox.ymin").alias("y0"), F.col("o.bndbox.xmax").alias("x1"), F.col("o.bndbox.ymax").alias("y1"))
    return found.select("filename", "width", "height", "region", F.col("o.name").alias("block_type"), box.alias("bbox"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, label) of a JSON object of labels, or of objects with a label; only the four modes."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("file", "entry"))
    label = F.lower(F.btrim(F.coalesce(F.get_json_object("entry", "$.label"), F.col("entry"))))
    return whole.select("file", label.alias("label")).where(F.col("label").isin("text", "layout", "ocr", "mixed"))


#: Extractors by name: each takes a DataFrame of binary files (path, content) and returns blocks. PDF, OCR and layout models register here.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str) -> Callable:
    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        EXTRACTORS[name] = f
        return f

    return register


@extractor("lines")
def extract_lines(files: DataFrame) -> DataFrame:
    """Plain text: a block for each line."""
    from lodeline.operators.ingest import line_blocks

    return line_blocks(files.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text")))


@extractor("html")
def extract_html(files: DataFrame) -> DataFrame:
    from lodeline.operators.ingest import html_blocks

    return html_blocks(files.select(F.col("path").alias("page_id"), F.decode("content", "UTF-8").alias("html")))


def extract(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Blocks of each file from the first named extractor that finds any, with ``backend``. Unknown names are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    done: DataFrame | None = None
    for name in names:
        left = files if done is None else files.join(done.select(F.col("doc_id").alias("path")).distinct(), "path", "left_anti")
        found = EXTRACTORS[name](left).select("doc_id", "page_index", "reading_order", "block_type", "text").withColumn("backend", F.lit(name))
        done = found if done is None else done.unionByName(found)
    return done


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON, or as CSV with nested columns as JSON text."""
    if kind == "csv":
        nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        rows.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns)).write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").json(path)


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A report of at most ``limit`` rows as a Markdown table."""
    cells = [rows.columns, ["---"] * len(rows.columns)] + [["" if v is None else str(v) for v in r] for r in rows.limit(limit).collect()]
    return "\n".join("| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in cells)
