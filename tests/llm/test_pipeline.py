"""The pipeline's stages one after the other, each against what its operator says of its input."""

import corpus_pipeline
from lodeline.llm import queries
from lodeline.llm.common import staged
from test_operators import jaccard, languages, passage


def test_stages(spark, tmp_path):
    item = passage(77)
    rows = [(i, t, k) for i, t, k in languages(60)]
    rows += [(100, rows[0][1], "aa"), (101, f"{rows[3][1]} {item} tail", "aa"), (102, None, "aa"), (103, "12 34", "bb"), (104, "", None)]
    table = [(i, t, k, f"s{i % 2}", len(t or "")) for i, t, k in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = queries.table(spark, str(tmp_path), "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(spark, stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        assert name == "token_files" or docs.columns == columns
    ids = {n: sorted(r["doc_id"] for r in rs) for n, rs in seen.items()}
    texts = {i: t for i, t, _ in rows}
    assert ids["language_id"] == [i for i in sorted(texts) if i not in (102, 103, 104)]
    groups = []
    for i in ids["language_id"]:
        if not any(jaccard(texts[i], texts[j]) >= 0.8 for j in groups):
            groups.append(i)
    assert ids["simhash_near_dedup"] == groups and 100 not in groups
    assert ids["benchmark_decontamination"] == [i for i in groups if i != 101]
    words = lambda rs: sum(len(r["text"].split()) for r in rs)
    before, after = words(seen["benchmark_decontamination"]), words(seen["mix_sources"])
    assert abs(after - 1.5 * before) <= 160 and set(ids["mix_sources"]) <= set(groups)
    assert ids["token_files"] == ids["mix_sources"] and corpus_pipeline.ORACLE_SQL is None
    starts = sorted((r["start"], r["n_tokens"]) for r in seen["token_files"])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, columns named like helpers, a very long text, an empty table."""
    names = ("row", "number", "copy", "copies", "turn", "_turn", "_copies", "lang_pred", "lang_score", "size", "taken", "node", "fp", "tile", "hash", "component", "item_id")
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    item, extra = passage(78), [f"is {c}" for c in names]
    rows = [(i if i % 5 else None, t, k, f"s{i % 2}", i, *extra) for i, t, k in languages(60)]
    rows += [(7, rows[7][1] + " " + passage(5), "bb", "s1", 500, *extra), (7, f"{rows[8][1]} {item}", "cc", "s1", 501, *extra), rows[9], (None, rows[11][1], rows[11][2], "s0", 502, *extra)]
    rows += [(300, " ".join(r[1] for r in rows[:58:3]) * 40, "aa", "s0", 503, *extra), (301, None, None, None, 504, *extra)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.createDataFrame(rows, kind)
    docs, seen = table, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(spark, stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "token_files":
            assert docs.columns == table.columns and all(list(r)[5:] == extra for r in seen[name])
    found = {n: sorted(r["n_chars"] for r in rs) for n, rs in seen.items() if n != "token_files"}
    every = sorted(r[4] for r in rows)
    assert found["language_id"] == [n for n in every if n != 504]
    # Row 9 is there twice; text 11 is there again without an id.
    assert found["simhash_near_dedup"] == sorted({*every} - {502, 504})
    assert found["benchmark_decontamination"] == sorted({*every} - {501, 502, 504})
    assert set(found["mix_sources"]) <= set(found["benchmark_decontamination"]) and len(seen["token_files"]) == len(found["mix_sources"])
    docs = table.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(spark, stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
