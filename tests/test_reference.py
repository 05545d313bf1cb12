import os
import re

import pytest
from pyspark.sql import functions as F

from lodeline.functions import text as X
from lodeline.operators import ingest, metrics, qa, retrieval, routing, scans
from lodeline.plans.answering import Engine
from lodeline.plans.oracle import oracle_sql
from lodeline.plans.queries import queries
from lodeline.sources.staging import staged

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, expression, **values):
    names = list(values) or ["x"]
    df = spark.createDataFrame([tuple(values.values()) or (None,)], ", ".join(f"{n} string" for n in names))
    return df.select(expression.alias("v")).first()[0]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    got = queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def shaped(df):
        return sorted(tuple("" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert shaped(got) == shaped(want)


def test_tokens_and_sentences(spark):
    assert one(spark, X.tokens(F.col("x")), x="The Straße of a TC, and x2 is LONG") == ["strasse", "tín", "chỉ", "x2", "long"]
    assert one(spark, X.sentences(F.col("x")), x="One. Two!  Three?") == ["One.", "Two!", "Three?"]
    assert one(spark, X.sentences(F.col("x")), x=" ") == []
    long = "a" * 200 + "; " + "b" * 100
    assert one(spark, X.sentences(F.col("x")), x=long) == ["a" * 200, "b" * 100]
    assert one(spark, X.token_f1(F.col("a"), F.col("b")), a="red red fox", b="red fox fox") == pytest.approx(2 / 3)
    assert one(spark, X.token_f1(F.col("a"), F.col("b")), a="", b="the") == 1.0
    assert one(spark, X.snippet(F.col("x")), x="w " * 400).endswith("...")
    assert one(spark, X.text_quality(F.col("x")), x=None) == 0.0


def test_words_and_quality_of_all_characters(spark):
    """Against the counts of all matches, over each character that has a code of two bytes."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    texts = [("".join(chars[i::61]), "") for i in range(61)] + [("".join(c * (i % 3 + 1) for i, c in enumerate(chars[j : j + 700])), "") for j in range(0, len(chars), 700)] + [("", ""), (" \n", ""), ("a\u0085b?\r\nqx\u00a0", "")]
    df = spark.createDataFrame(texts, "x string, y string")
    x = F.col("x")
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    n = F.greatest(F.char_length(t), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")), lambda v: v != "")
    k = F.greatest(F.size(lines), F.lit(1))
    part = lambda test: F.size(F.filter(lines, test)) / k
    score = 0.25 * share(r"[^\p{C}\p{Zl}\p{Zp}\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]") + 0.25 * share(r"[\p{L}\p{N}]") + 0.10 * F.least(share(r"(?U)\s") / 0.15, F.lit(1.0))
    score = score - 0.30 * share(r"[@#$%^&*_+=~`|<>\[\]{}]") - 0.50 * F.least(share(r"\?") * 10, F.lit(0.5)) - 0.20 * F.least(share("[qxwvQXWV]") * 5, F.lit(0.2))
    score = score + 0.15 * F.least(F.aggregate(F.transform(lines, F.char_length), F.lit(0).cast("long"), lambda a, b: a + b) / k / 40.0, F.lit(1.0)) - 0.40 * part(lambda v: F.char_length(v) <= 5) - 0.30 * part(lambda v: F.char_length(v) == 1)
    whole = F.when(t == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))
    found = df.select(X.text_quality(x).alias("a"), whole.alias("b"), X.words(x).alias("c"), F.regexp_extract_all(F.lower(x), F.lit(X.WORD), F.lit(0)).alias("d"), ingest.upper_share(x).alias("e"), F.when(F.regexp_count(x, F.lit(r"\p{L}")) > 0, F.regexp_count(x, F.lit(r"\p{Lu}")) / F.regexp_count(x, F.lit(r"\p{L}"))).otherwise(0.0).alias("f")).collect()
    assert all(r.c == r.d and r.a == pytest.approx(r.b, abs=1e-12) and r.e == pytest.approx(r.f, abs=1e-12) for r in found) and any(r.a > 0 for r in found)


def test_only_texts_with_labels_are_rated(spark, tmp_path):
    from lodeline.plans import queries as plans

    spark.createDataFrame([(i, "Some words of a text.", 21) for i in range(20)], "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    graded = plans._graded(spark, str(tmp_path))
    plan = graded._jdf.queryExecution().optimizedPlan().toString()
    assert rows(graded.select("doc_id", "quality"), "doc_id", "quality") == [(3, 0), (3, 1), (5, 1)]
    assert plan.index("regexp_replace") < plan.index("Join")


def test_a_line_is_made_once(spark):
    made = ingest.normalised(blocks(spark, [(0, "paragraph", "•  one  item"), (0, "paragraph", "12"), (0, "table", "a | b")]))
    assert rows(made.select("text", "block_type", "markdown"), "reading_order") == [("• one item", "heading", "## • one item"), ("a | b", "table", "a | b")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("•, •") <= 3  # for the text, and for Markdown of it
    exploded = ingest.clean(blocks(spark, [(0, "paragraph", "one"), (1, "paragraph", "two")]))
    assert exploded._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # no document has three pages, so nothing is counted


@pytest.mark.parametrize(
    "text, kind, number",
    [
        ("2.1 Steps to follow", "heading", "2.1"),
        ("1 Understand the process", "list_item", "1"),
        ("a) first item ends here with a full stop.", "list_item", "a)"),
        ("Email: x@y.z", "metadata", None),
        ("Điều 5. Phạm vi", "heading", None),
        ("This is a plain line of text that goes on for more than ten words.", "paragraph", None),
    ],
)
def test_block_types(spark, text, kind, number):
    df = spark.createDataFrame([(text, "paragraph")], "t string, g string")
    assert df.select(ingest.block_type(F.col("t"), F.col("g")), ingest.item_number(F.col("t"))).first() == (kind, number)


def test_noise_and_markdown(spark):
    df = spark.createDataFrame([(t,) for t in ("12", "ABSTRACT", "-", "a", "MỤC I", "Real words here.")], "t string")
    assert [r[0] for r in df.select(ingest.is_noise(F.col("t"))).collect()] == [True, True, True, False, False, False]
    assert one(spark, ingest.markdown(F.col("x"), F.lit("list_item")), x="2) do it") == "- do it"


def blocks(spark, items):
    return spark.createDataFrame(
        [("d", p, i, f"b{i}", kind, text, None, None) for i, (p, kind, text) in enumerate(items)],
        "doc_id string, page_index int, reading_order int, block_id string, block_type string, text string, y0 double, y1 double",
    )


def test_merge_joins_broken_paragraphs(spark):
    left = "this long paragraph line has more than ten words in it and ends with infor-"
    made = ingest.merged(ingest.gathered(blocks(spark, [(0, "paragraph", left), (0, "paragraph", "mation continues here and is closed by a full stop in the end."), (1, "paragraph", "next page starts with a lower case word and has many more words than ten.")])))
    found = made.first()["blocks"]
    assert [b["text"] for b in found] == [left[:-1] + "mation continues here and is closed by a full stop in the end.", "next page starts with a lower case word and has many more words than ten."]
    assert found[0]["block_ids"] == ["b0", "b1"] and [b["reading_order"] for b in found] == [0, 0]


def test_heading_paths_pop_by_length(spark):
    texts = ["1. One", "1.1.1 A", "1.1.1 B", "1.1.1 C", "1.1 D"]
    made = ingest.structured(ingest.merged(ingest.gathered(blocks(spark, [(0, "heading", t) for t in texts]))))
    assert [len(b["heading_path"]) for b in made.first()["blocks"]] == [1, 2, 3, 3, 2]


def test_chunks(spark):
    items = [(0, "heading", "1. Top"), (0, "paragraph", "x" * 700 + "."), (0, "paragraph", "Y" + "y" * 600 + "."), (1, "table", "a | b"), (1, "paragraph", "Z" * 3000)]
    made = ingest.chunks(ingest.structured(ingest.gathered(blocks(spark, items)).withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["page_index"].alias("page_index"), b["reading_order"].alias("reading_order"), b["block_type"].alias("block_type"), b["text"].alias("text"), F.array(b["block_id"]).alias("block_ids"))))))
    found = made.orderBy("chunk_index").collect()
    assert [len(r["text"]) for r in found] == [708, 602, 5, 3000]
    assert [r["is_table_chunk"] for r in found] == [False, False, True, False] and found[0]["chunk_id"] == "chunk_00000"
    corpus = ingest.corpus_of(made, "src").orderBy("chunk_idx").collect()
    assert [r["chunk_idx"] for r in corpus] == [0, 1, 2, 3] and corpus[2]["block_type"] == "table" and corpus[0]["section"] == "1. Top"


def test_repeated_headers(spark):
    items = [("d", p, 0, f"b{p}", "paragraph", t, y, None) for p, t, y in [(0, "Head", None), (1, "head", None), (2, "HEAD", None), (3, "other one", 10.0), (4, "other two", None)]]
    df = spark.createDataFrame(items, "doc_id string, page_index int, reading_order int, block_id string, block_type string, text string, y0 double, y1 double")
    assert rows(ingest.repeated_texts(df)) == [("d", "head", 3, 0)]
    assert ingest.without_repeated(df, ingest.repeated_texts(df)).count() == 2


def test_probe_modes(spark):
    pages = [("scan", i, "", 1, 1) for i in range(3)] + [("rich", i, "word " * 60, 20, 0) for i in range(2)] + [("plain", 0, "word " * 60, 3, 0)]
    found = ingest.probe(spark.createDataFrame(pages, "doc_id string, page_index int, text string, block_count long, image_count long"))
    assert rows(found.select("doc_id", "mode"), "doc_id") == [("plain", "text"), ("rich", "layout"), ("scan", "ocr")]


def corpus(spark):
    items = [(0, "red fox jumps", "en"), (1, "blue fox sleeps", "en"), (2, "red red wine", "fr"), (3, "nothing here", None)]
    return retrieval.as_corpus(spark.createDataFrame([(i, t, l, "s") for i, t, l in items], "doc_id long, text string, lang string, source string"))


def test_bm25_and_filters(spark, tmp_path):
    asked = spark.createDataFrame([(1, "red jumps wine"), (2, "zebra"), (3, None)], "query_id long, query string")
    index = retrieval.build_index(corpus(spark))
    found = rows(retrieval.bm25(index, asked, 3).select("query_id", "chunk_idx", "rank"), "query_id", "rank")
    assert [r[:2] for r in found] == [(1, 0), (1, 2)] or [r[:2] for r in found] == [(1, 2), (1, 0)]
    index.save(str(tmp_path))
    again = retrieval.SparseIndex.load(spark, str(tmp_path))
    assert rows(retrieval.bm25(again, asked, 3).select("query_id", "chunk_idx", "rank"), "query_id", "rank") == found
    none = "cast(null as array<string>)"
    only = asked.withColumn("filters", F.expr(f"struct({none}, {none}, {none}, {none}, {none}, {none}, map('lang', array('FR ')))"))
    assert [r[1] for r in rows(retrieval.bm25(index, only, 3, corpus(spark)).select("query_id", "chunk_idx"))] == [2]


def okapi(items, asked):
    """Brute force over (chunk_idx, words) and (query_id, words): the scores above 0."""
    from math import log

    n, mean = len(items), sum(len(w) for _, w in items) / len(items)
    df = {t: sum(t in w for _, w in items) for _, ws in items for t in ws}
    raw = {t: log(n - k + 0.5) - log(k + 0.5) for t, k in df.items()}
    idf = {t: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for t, r in raw.items()}
    part = lambda t, w: idf.get(t, 0.0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean))
    return {(q, i): s for q, ts in asked for i, w in items if (s := sum(part(t, w) for t in ts)) > 0}


def test_search_leaves_only_the_best_chunks(spark, monkeypatch):
    import random

    dice = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(dice.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=dice.randint(1, 40))), dice.choice(["en", "fr", "de"])) for i in range(300)]
    asked = [(f"q{i}", " ".join(dice.choices(vocabulary, k=4))) for i in range(12)]
    c = retrieval.as_corpus(spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, lang string, source string").repartition(3))
    queries = spark.createDataFrame(asked, "query_id string, query string")
    want = okapi([(i, ["paragraph", *t.split()]) for i, t, _ in texts], [(q, t.split()) for q, t in asked])
    index = retrieval.build_index(c)
    best = lambda ok: sorted((q, i, k + 1, round(s, 7)) for q, _ in asked for k, (s, i) in enumerate(sorted(((s, i) for (p, i), s in want.items() if p == q and ok(q, i)), key=lambda x: (-round(x[0], 9), x[1]))[:5]))
    shown = lambda hits: rows(hits.select("query_id", "chunk_idx", "rank", F.round("raw", 7)), "query_id", "chunk_idx")
    found = retrieval.bm25(index, queries, 5)
    assert shown(found) == best(lambda q, i: True)
    assert "keys=[query_id" not in found._jdf.queryExecution().toString()  # no pair of a query and a chunk is shuffled to be added up
    none = "cast(null as array<string>)"
    narrow = queries.withColumn("filters", F.expr(f"struct({none} as a, {none} as b, {none} as c, {none} as d, {none} as e, {none} as f, map('lang', array(if(query_id < 'q2', 'fr', 'de'))) as g)"))
    allowed = best(lambda q, i: texts[i][2] == ("fr" if q < "q2" else "de"))
    posted = retrieval.with_postings(index.postings, index.size, index.mean_length)
    for one_pass in (True, False):
        monkeypatch.setattr(retrieval, "ASKED_ROWS", 200_000 if one_pass else 25)
        assert shown(retrieval.bm25(index, narrow, 5, c)) == allowed == shown(retrieval.bm25(posted, narrow, 5, c))
    monkeypatch.setattr(retrieval, "HELD", 1)
    assert shown(retrieval.bm25(index, queries, 5)) == best(lambda q, i: True)
    holds = {(q, i) for q, t in asked for i, text, _ in texts if set(t.split()) <= set(text.split())}
    assert {r[:2] for r in rows(retrieval.shared_words(index, queries, None))} == holds and holds


def test_chunks_that_share_a_number(spark):
    c = retrieval.as_corpus(spark.createDataFrame([(1, "red fox", "en", "s"), (1, "red wine jar", "en", "s"), (2, "red hat", "en", "s"), (None, "blue hat", "en", "s"), (3, "a b c", "en", "s")], "doc_id long, text string, lang string, source string"))
    index = retrieval.build_index(c)
    assert index.documents is None
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue")], "query_id long, query string")
    assert rows(retrieval.bm25(index, asked, 5).select("query_id", "chunk_idx", "rank"), "query_id", "rank") == [(1, 1, 1), (1, 2, 2), (2, None, 1)]


def test_gold_of_short_items_as_sql(spark, tmp_path):
    import duckdb

    texts = ["The red fox jumps over a wall.", "Redfox and hat", "a hat, a red fox", "nothing", "hats"] + [f"filler {i}" for i in range(8)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "red fox jumps"), (1, "hat"), (2, "red fox"), (3, "fox jumps over"), (4, "zebra")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries()["retrieval_eval"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['retrieval_eval']}) ORDER BY query_id").fetchall()
    assert [tuple(None if v is None else float(v) for v in r) for r in rows(got, "query_id")] == [tuple(None if v is None else float(v) for v in r) for r in want] and len(want) == 4


def test_fusion_context_and_rerank(spark):
    a = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 1.0, 2)], "query_id long, chunk_idx long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 0.9, 1), (1, 12, 0.1, 2)], "query_id long, chunk_idx long, score double, rank int")
    assert [(r[0], round(r[1], 6)) for r in rows(retrieval.fuse_weighted(a, b, (1, 1), 5).select("chunk_idx", "score", "rank"), "rank")] == [(10, 0.5), (11, 0.5), (12, 0.0)]
    assert rows(retrieval.fuse_rrf(a, b, (1, 1), 5).select("chunk_idx", "rank"), "rank")[0] == (11, 1)
    ids = spark.range(9, 13).select(F.col("id").alias("chunk_idx"))
    near = retrieval.expand_context(a.withColumn("score", F.lit(0.5)), ids, 1)
    assert rows(near.select("chunk_idx", "score"), "rank") == [(10, 0.5), (9, 0.49), (11, 0.49), (12, 0.49)]
    hits = spark.createDataFrame([(1, 1, 0.5, 1), (1, 0, 0.4, 2), (1, 3, 0.45, 3)], "query_id long, chunk_idx long, score double, rank int")
    asked = spark.createDataFrame([(1, "red fox jumps")], "query_id long, query string")
    assert [r[0] for r in rows(retrieval.rerank(hits, corpus(spark), asked, 2, blend=0.9).select("chunk_idx"), "rank")] == [0, 1, 3]


def test_late_interaction(spark):
    docs = spark.createDataFrame([(0, [[1.0, 0.0]]), (1, [[0.0, 1.0], [0.6, 0.8]])], "chunk_idx long, vectors array<array<double>>")
    asked = spark.createDataFrame([(1, [[0.0, 1.0]])], "query_id long, vectors array<array<double>>")
    assert rows(retrieval.late_interaction(docs, asked, 2).select("chunk_idx", "raw", "score"), "rank") == [(1, 1.0, 1.0), (0, 0.0, 0.0)]


def test_dense_handles_missing_vectors(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None)], "chunk_idx long, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, embedding array<float>")
    assert rows(retrieval.dense(docs, asked, 5).select("query_id", "chunk_idx", "score"), "rank") == [(7, 1, 1.0), (7, 0, 0.5)]


def test_dense_holds_the_best_of_a_task(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    dice = np.random.default_rng(5)
    x = dice.normal(size=(400, 8)).round(1)
    x[200:300] = x[:100]  # equal vectors, so that the smaller number decides
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(q, int(i), k + 1) for q in range(0, 400, 9) for k, i in enumerate(np.lexsort((np.arange(400), -(y @ y[q]).round(9)))[:6])]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_idx long, embedding array<double>").repartition(3)
    asked = docs.where("chunk_idx % 9 = 0").withColumnRenamed("chunk_idx", "query_id")
    for numbers, blocks, held in ((131_072, 64, 10**6), (160, 64, 10**6), (160, 0, 1)):
        monkeypatch.setattr(retrieval, "VECTORS", numbers)
        monkeypatch.setattr(retrieval, "QUERY_BLOCKS", blocks)
        monkeypatch.setattr(retrieval, "HELD", held)
        assert rows(retrieval.dense(docs, asked, 6).select("query_id", "chunk_idx", "rank"), "query_id", "rank") == want
    monkeypatch.setattr(retrieval, "HELD", 10**6)
    ids = lambda a, b: np.arange(a, b).tobytes()
    pairs = [(ids(i, i + 50), y[i : i + 50].tobytes(), ids(0, 20), y[:20].tobytes()) for i in range(0, 400, 50)]
    batches = (pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in p], ["ids", "x", "qids", "qx"]) for p in pairs)
    assert sum(b.num_rows for b in retrieval._nearest(6)(batches)) == 20 * 6  # not six of each block


@pytest.mark.parametrize(
    "question, kind",
    [("Compare A and B", "comparison"), ("How many days?", "factoid"), ("How do I pay?", "procedural"), ("Why so?", "definition"), ("What is tax?", "definition"), ("The policy must hold for all of us here", "policy"),
     ("", "factoid"), ("please tell me about the large house that stands over there", "ambiguous")],
)
def test_routes(spark, question, kind):
    assert one(spark, routing.query_type(F.col("x")), x=question) == kind


def test_candidate_types(spark):
    assert one(spark, routing.candidate_types(F.lit("factoid"), F.col("x")), x="what must I compare") == ["factoid", "policy", "comparison", "definition", "ambiguous"]


def test_answers(spark):
    asked = spark.createDataFrame([(1, "What is the refund email?", "definition"), (2, "What is a quark?", "definition")], "query_id long, question string, query_type string")
    hits = spark.createDataFrame(
        [(1, 1, 1.0, "c1", "d", "s", "Refunds", "The refund email is pay@shop.org. Write soon."), (1, 2, 0.2, "c2", "d", "s", "Other", "Nothing else matters.")],
        "query_id long, rank int, score double, chunk_id string, doc_id string, source_name string, section string, text string",
    )
    assessed = qa.evidence(asked, hits)
    found = {r["query_id"]: r for r in qa.quality(qa.answers(assessed, hits)).collect()}
    assert found[1]["decision"] == "answer" and "pay@shop.org" in found[1]["answer"] and found[1]["grounded"]
    assert found[1]["relevance"] == pytest.approx(0.65 + 0.25 * 0.6 + 0.08)
    assert found[2]["decision"] == "switch_strategy" and found[2]["citations"] == [] and found[1]["quality"] > found[2]["quality"]


def test_engine_and_retries(spark):
    facts = [(0, "The office is in Lyon. It opens at nine.", "en"), (1, "Leave is 25 days a year for each employee.", "en"), (2, "Cats sleep.", "en")]
    c = retrieval.as_corpus(spark.createDataFrame([(i, t, l, "s") for i, t, l in facts], "doc_id long, text string, lang string, source string"))
    index = retrieval.build_index(c)
    engine = Engine(c, retrieval.with_postings(staged(spark, index.postings, "postings"), index.size, index.mean_length))
    asked = spark.createDataFrame([(1, "How many days of leave for an employee?"), (2, "Which quasar is brightest?")], "query_id long, question string")
    found = {r["query_id"]: r for r in engine.answer_adaptively(asked, attempts=2).collect()}
    assert "25 days" in found[1]["answer"] and found[2]["decision"] != "answer" and set(found) == {1, 2}


def test_configurations(spark):
    from lodeline.plans.answering import CONFIGS, config_names

    assert config_names(["bm25_only, no_router", "bm25_only"]) == ["bm25_only", "no_router"] and config_names(["all"]) == list(CONFIGS)
    with pytest.raises(ValueError, match="nothing"):
        config_names(["nothing"])
    c = retrieval.as_corpus(spark.createDataFrame([(0, "Leave is 25 days a year for each employee.", "en", "s"), (1, "Cats sleep.", "en", "s"), (2, "The office is in Lyon.", "en", "s")], "doc_id long, text string, lang string, source string"))
    index = retrieval.build_index(c)
    engine = Engine(c, retrieval.with_postings(staged(spark, index.postings, "postings"), index.size, index.mean_length))
    asked = spark.createDataFrame([(1, "How many days of leave for an employee?"), (2, "Which quasar shines brightest?")], "query_id long, question string")
    names = ["bm25_only", "dense_only", "no_evidence_checker", "no_citation_grounding"]
    found = {(r["config_name"], r["query_id"]): r for r in engine.answer_all(asked, names).collect()}
    assert len(found) == 8 and "25 days" in found["bm25_only", 1]["answer"] and found["bm25_only", 2]["decision"] != "answer"
    assert found["dense_only", 1]["decision"] == "switch_strategy"
    assert {found["no_evidence_checker", q]["decision"] for q in (1, 2)} == {"answer"} and found["no_evidence_checker", 2]["sufficiency"] == 0.0
    assert found["no_citation_grounding", 1]["citations"] == [] and "25 days" in found["no_citation_grounding", 1]["answer"]


def test_scan_lines(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    kind = f"doc_id string, page_index int, line int, text string, score double, bbox {box}"
    row = lambda page, n, text, y, score=0.9: ("d", page, n, text, score, (10.0, y, 500.0, y + 10.0))
    lines = [row(0, i, f"item {i} 12,5 30", 12.0 * i) for i in range(10)]
    lines += [row(0, 10 + i, "a long line of words that has nothing to count in it at all", 400.0 + 12.0 * i) for i in range(4)]
    lines += [row(1, i, "three short words", 14.0 * i) for i in range(5)] + [row(2, 0, None, 0.0), ("d", 2, 1, "no box", None, None)]
    lines += [row(3, i, "one two", 40.0 * i) for i in range(24)]
    df = spark.createDataFrame(lines, kind)
    pages = spark.createDataFrame([("d", p, 600.0, 600.0) for p in range(4)], "doc_id string, page_index int, width double, height double")
    found = {r["page_index"]: r for r in scans.table_blocks(df, pages).collect()}
    assert set(found) == {0, 3} and found[0]["n_lines"] == 10 and found[0]["text"].startswith("item 0 12,5 30\nitem 1") and found[0]["confidence"] == pytest.approx(0.9)
    assert found[3]["n_lines"] == 20 and found[3]["bbox"]["y0"] == 80.0
    assert scans.table_blocks(df.where("1 = 0"), pages).count() == 0
    weak = spark.createDataFrame([row(0, 0, "x", 0.0, 0.4), row(0, 1, "y", 0.0, None), row(0, 2, " ", 0.0)], kind)
    assert [r["text"] for r in scans.confident(weak).collect()] == ["y"]
    assert [one(spark, scans.line_type(F.col("x")), x=t) for t in ("- a", "TOTAL", "2. Scope", "plain", None)] == ["list_item", "heading", "heading", "paragraph", "paragraph"]


def test_runs(spark):
    kind = "run int, success_rate double, iou50_micro_f1 double, iou75_micro_f1 double, latency_p95_sec double, backend_counts map<string,int>, route_counts map<string,int>"
    runs = spark.createDataFrame([(1, 1.0, 0.97, 0.8, 2.0, {"a": 3}, {"t": 1, "u": 1}), (2, 0.9, 0.9, 0.7, 3.0, {"a": 2, "b": 1}, None)], kind)
    assert rows(metrics.run_gates(runs), "run") == [(1, True, True, True, True, True), (2, False, False, False, False, False)]
    found = metrics.stability(runs).first()
    assert (found["runs"], found["success_rate_min"], found["latency_p95_sec_max"]) == (2, 0.9, 3.0)
    assert found["backend_consistent"] and not found["route_consistent"] and list(found["dominant_routes"]) == ["", "t"]
    assert metrics.stability(runs.where("run > 5")).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "query_id long, chunk_idx long, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 7), (2, 8), (1, 6)], "query_id long, chunk_idx long")
    per = {r["query_id"]: r for r in metrics.retrieval_metrics(hits, gold, spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), 5).collect()}
    assert (per[1]["recall"], per[1]["mrr"], per[2]["hit"]) == (0.5, 0.5, 0.0) and set(per) == {1, 2}
    summary = spark.createDataFrame([("a", 0.5)], "metric string, value double")
    assert rows(metrics.gates(summary, [("x", "a", "min", 0.5), ("y", "a", "max", 0.4), ("z", "b", "min", 0.0)]).select("name", "passed"), "name") == [("x", True), ("y", False), ("z", False)]
    deltas = metrics.profile_deltas(spark.createDataFrame([("p", "m", 0.0), ("q", "m", 2.0)], "profile string, metric string, value double"), "p", "q")
    assert rows(deltas.select("delta", "delta_relative")) == [(2.0, None)]


def test_table_cells(spark):
    words = [("r", x, y, x + 20.0, y + 10.0, t) for y, line in ((0.0, "a b c"), (30.0, "d e f")) for x, t in zip((0.0, 22.0, 120.0), line.split())]
    df = spark.createDataFrame(words, "region string, x0 double, y0 double, x1 double, y1 double, text string")
    assert rows(metrics.table_markdown(metrics.table_cells(df)))[0][1] == "| a b | c |\n| --- | --- |\n| d e | f |"


def test_case_matching(spark):
    case = "struct(cast(null as array<string>) as expected_chunk_ids, cast(null as string) as expected_chunk_id, 's' as source_name, cast(null as string) as doc_id, array(2) as expected_pages, '' as expected_section, 'FOX' as match_text)"
    hit = "struct('c' as chunk_id, 's' as source_name, 'd' as doc_id, 2 as page, 'x' as section, 'a fox' as text)"
    assert spark.range(1).select(metrics.is_match(F.expr(case), F.expr(hit))).first()[0] is True


def test_readers(spark, tmp_path):
    from lodeline.sources import files

    (tmp_path / "a.json").write_text('{"chunks": [{"chunk_id": "c1", "text": "t", "page_start": 0, "heading_path": ["A", "B"]}]}')
    (tmp_path / "b.jsonl").write_text('{"chunk_id": "c2", "markdown": "m", "block_types": ["heading", "table"]}\n\n')
    (tmp_path / "c.json").write_text('[{"id": "q1", "question": "Why?", "answerable": false}]')
    a, b, c = files.read_chunks(spark, str(tmp_path / "a.json")).first(), files.read_chunks(spark, str(tmp_path / "b.jsonl")).first(), files.read_cases(spark, str(tmp_path / "c.json")).first()
    assert (a["page"], a["section"], a["block_type"]) == (1, "B", "paragraph") and (b["text"], b["block_type"]) == ("m", "table")
    assert (c["query_id"], c["query"], c["should_answer"]) == ("q1", "Why?", False)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.txt").write_text("one\n\ntwo")
    assert [r["text"] for r in files.extract(spark, str(tmp_path / "docs"), ["lines", "html"]).orderBy("reading_order").collect()] == ["one", "two"]
    (tmp_path / "v.xml").write_text("<annotation><filename>f</filename><size><width>9</width><height>8</height></size><object><name>table</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert files.read_voc(spark, str(tmp_path / "v.xml")).first()["bbox"]["x1"] == 3.0


def test_stream_refresh(spark, tmp_path):
    from lodeline.streaming.refresh import index_stream

    spark.createDataFrame([(1, "red fox", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, lang string, source string").parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"paragraph", "red", "fox"}


def test_entry_imports_without_the_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    assert not [p for p in root.glob("lodeline/**/*.py") if "llm" not in p.parts and re.search(r"lodeline\.llm|from \.+llm", p.read_text())]
    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n else f(n, *a); import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_markdown_and_extraction(spark):
    from lodeline.operators import extraction as E

    text = "# Title\npara one\nstill one\n\n- item\n| a | b |\n|---|---|\n| c | d |\n# x | y\nend\n  \n#no\n"
    got = rows(E.markdown_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, markdown string")).select("doc_id", "reading_order", "block_type", "level", "text"), "doc_id", "reading_order")
    assert got == [
        (1, 0, "heading", 1, "Title"), (1, 1, "paragraph", None, "para one\nstill one"), (1, 2, "list_item", None, "item"),
        (1, 3, "table", None, "| a | b |\n|---|---|\n| c | d |\n# x | y"), (1, 4, "paragraph", None, "end"), (1, 5, "paragraph", None, "#no"),
    ]
    kinds = spark.createDataFrame([("Section-Header",), ("TABLE",), (None,), ("picture image",)], "k string")
    assert [r[0] for r in kinds.select(E.normal_block_type(F.col("k"))).collect()] == ["heading", "table", "paragraph", "figure"]
    pages = spark.createDataFrame([(1, "text"), (1, "ocr"), (1, "layout"), (2, "text")], "doc_id long, extractor string")
    blocks = spark.createDataFrame([(1, "text", "paragraph", "short", False, None), (1, "ocr", "paragraph", "x", False, None), (1, "layout", "table", "t", True, None)], "doc_id long, extractor string, block_type string, text string, has_bbox boolean, route string")
    valid = E.valid_results(pages, blocks)
    assert rows(valid, "doc_id", "extractor") == [(1, "layout", False), (1, "ocr", True), (1, "text", False), (2, "text", False)]
    plans = spark.createDataFrame([(1, ["text", "layout", "ocr"]), (2, ["text"])], "doc_id long, plan array<string>")
    assert rows(E.chosen_extractors(plans, valid), "doc_id") == [(1, "ocr", 2), (2, None, 1)]


def test_answer_evidence(spark):
    case = "struct(cast(null as array<string>) as expected_chunk_ids, array('Leave') as expected_sections, array(9) as expected_pages, '' as match_text, 's' as source_name)"
    hit = "struct('c' as chunk_id, '{}' as source_name, {} as page, '{}' as section, array('A') as heading_path, '' as snippet, 'text' as text)"
    one = spark.range(1)
    found = [one.select(metrics.evidence_match(F.expr(case), F.array(F.expr(hit.format(*h))))).first()[0] for h in (("s", 9, "x"), ("s", 1, "on leave"), ("t", 9, "leave"), ("s", 1, "x"))]
    assert found == [True, True, False, False]
    by_id = case.replace("cast(null as array<string>)", "array('c')")
    assert one.select(metrics.evidence_match(F.expr(by_id), F.array(F.expr(hit.format("t", 1, "x"))))).first()[0]
    m = one.select(metrics.answer_match(F.lit("ten days of leave"), F.lit(""), F.lit("ten days leave")).alias("m")).first()["m"]
    assert m["matches"] and m["token_f1"] > 0.8 and not m["contains_expected"]
    s = one.select(metrics.answer_status(F.lit("answer"), F.lit(False), F.lit(False), F.lit(True)).alias("s")).first()["s"]
    assert (s["hallucinated"], s["end_to_end_success"]) == (True, False)


def test_case_metrics(spark):
    case = "query_id int, expected_chunk_ids array<string>, expected_chunk_id string, source_name string, doc_id string, expected_pages array<int>, expected_section string, match_text string"
    cases = spark.createDataFrame([(1, ["a", "b"], "a", None, None, None, None, None), (2, None, None, "s", None, None, None, " Word"), (3, None, None, None, None, [7], None, None), (4, None, None, None, None, None, None, None)], case)
    hit = "strategy string, query_id int, rank int, score double, chunk_id string, source_name string, doc_id string, page int, section string, text string"
    found = [
        ("x", 1, 1, 1.0, "c", None, None, None, None, None), ("x", 1, 2, 0.5, "b", None, None, None, None, None), ("x", 2, 1, 1.0, "d", "t", None, None, None, "a word"), ("x", 2, 3, 0.2, "e", "s", None, None, None, "A WORD"),
        ("x", 4, 1, 1.0, "d", None, None, None, None, "w"), ("x", 1, 11, 0.1, "a", None, None, None, None, None),
    ]
    got = {r["query_id"]: r for r in metrics.case_metrics(cases, spark.createDataFrame(found, hit), 10, ("x",)).collect()}
    assert {q: (r["hit"], r["first_match_rank"], r["recall"], r["retrieval_count"]) for q, r in got.items()} == {1: (True, 2, 0.5, 2), 2: (True, 3, 1.0, 2), 3: (False, None, 0.0, 0), 4: (False, None, 0.0, 1)}
    assert got[1]["mrr"] == 0.5 and got[1]["ndcg"] == pytest.approx(0.63093 / 1.63093, abs=1e-5) and got[1]["top_hit_chunk_id"] == "c" and got[3]["top_hit_chunk_id"] is None
    total = metrics.strategy_summary(metrics.case_metrics(cases, spark.createDataFrame(found, hit), 10, ("x",))).first()
    assert total["query_count"] == 4 and total["hit"] == 0.5 and total["retrieval_count"] == 1.25
    assert metrics.case_metrics(cases, spark.createDataFrame([], hit), 10, ("x", "y")).where("not hit and ndcg = 0").count() == 8


def test_answers_against_citations(spark):
    df = spark.createDataFrame(
        [("fee is ten dollars", "answer", ["c"], [], "The fee is ten dollars."), ("fee", "answer", [], ["fee"], "fee"), ("red fox", "abstain", [], None, None), ("green tree house", "answer", ["c"], ["other"], "nothing shared"), ("The fee", "answer", ["c"], ["the fee is due"], None)],
        "a string, d string, c array<string>, s array<string>, t string",
    )
    assert [r[0] for r in df.select(metrics.cited_support(*(F.col(c) for c in "adcst"))).collect()] == [True, False, True, False, True]
    labels = spark.createDataFrame([(True, "answer"), (True, "abstain"), (False, "answer"), (False, "abstain")], "d boolean, x string")
    assert [r[0] for r in labels.select(metrics.answer_label(F.col("d"), F.col("x"))).collect()] == ["answered", "missed_answer", "wrongly_answered", "correct_abstention"]
