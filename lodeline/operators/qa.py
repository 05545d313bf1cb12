"""Evidence scores and extractive, cited answers for a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as X

#: Thresholds of the decision, and words of questions that ask for a number.
ANSWER, WEAK, GROUNDED, COVERED = 0.52, 0.35, 0.25, 0.45
NUMERIC = (
    "how many", "how much", "how long", "what score", "what bleu", "bleu score", "what f1", "f1 score", "what value", "what size", "what dimension",
    "what rate", "what beam", "what length penalty", "bao nhiêu", "bao lâu", "mấy", "tối đa", "tối thiểu", "khi nào", "thời hạn", "điểm chữ",
)
WIDE = ("comparison", "multi_hop", "procedural")
_EMAIL = r"[\w.\-+]+@[\w.\-]+\.\w+"
_NUMBER = r"(?U)\b\d+(?:[,.]\d+)?"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def best_sentences(scored: Column, most: int = 3) -> Column:
    """The first distinct sentences of an array of (score, sentence), by score, earlier ones first among equals."""
    numbered = F.transform(scored, lambda x, i: F.struct((-x["score"]).alias("k"), i.alias("i"), x["sentence"].alias("sentence"), X.folded(x["sentence"]).alias("fold")))

    def distinct(ordered: Column) -> Column:
        first = lambda folds: F.filter(ordered, lambda x, i: F.array_position(folds, x["fold"]) == i + 1)
        return F.slice(F.transform(X.let(F.transform(ordered, lambda x: x["fold"]), first), lambda x: x["sentence"]), 1, most)

    return X.let(F.array_sort(numbered), distinct)


def evidence(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Scores and a decision for each question.

    ``questions``: query_id, question, query_type. ``hits``: query_id, rank,
    score, chunk_id, doc_id, source_name, section, text. Of the first two
    hits, or three for types that need breadth, come relevance, coverage,
    consistency, citation support, grounding and, weighted by type,
    sufficiency. Scores aren't rounded.
    """
    fields = F.struct("rank", "score", "chunk_id", "doc_id", "source_name", "section", "text")
    heads = hits.where(F.col("rank") <= 3).groupBy("query_id").agg(F.sort_array(F.collect_list(fields)).alias("hits"))
    q = questions.join(heads, "query_id", "left").withColumn("terms", X.token_set(F.col("question")))
    q = q.withColumn("chosen", F.slice("hits", F.lit(1), F.when(F.col("query_type").isin(*WIDE), 3).otherwise(2)))
    top1, top2 = F.try_element_at("hits", F.lit(1))["score"], F.coalesce(F.try_element_at("hits", F.lit(2))["score"], F.lit(0.0))
    n, size = F.size("chosen"), F.size("terms")
    gap = F.greatest(F.lit(0.0), top1 - top2)
    mean = _sum(F.transform("chosen", lambda h: h["score"])) / n
    covered = F.array_distinct(F.flatten(F.transform("chosen", lambda h: F.array_intersect("terms", X.token_set(F.concat_ws(" ", F.coalesce(h["section"], F.lit("")), F.coalesce(h["text"], F.lit(""))))))))
    docs = F.size(F.array_distinct(F.transform("chosen", lambda h: F.coalesce(F.nullif(h["doc_id"], F.lit("")), F.nullif(h["source_name"], F.lit("")), F.lit("")))))
    sections = F.size(F.array_distinct(F.filter(F.transform("chosen", lambda h: h["section"]), lambda s: F.coalesce(s, F.lit("")) != "")))
    cited = F.size(F.filter("chosen", lambda h: (F.coalesce(h["chunk_id"], F.lit("")) != "") & (F.coalesce(F.nullif(h["source_name"], F.lit("")), h["doc_id"], F.lit("")) != "")))
    spans = F.flatten(F.transform("chosen", lambda h: X.sentences(h["text"])))
    shared = lambda ts: F.struct(F.size(F.array_intersect("terms", ts)).alias("overlap"), F.size(ts).alias("n"))
    weigh = lambda s: X.let(X.let(X.token_set(s), shared), lambda o: F.struct((o["overlap"] + 0.01 * o["n"]).alias("score"), s.alias("sentence"), o["overlap"].alias("overlap")))
    scored = F.transform(spans, weigh)
    q = q.withColumn("support_sentences", best_sentences(F.filter(scored, lambda x: (x["overlap"] > 0) | (F.size("terms") == 0))))
    q = q.select(
        "*",
        F.least(F.lit(1.0), 0.65 * top1 + 0.25 * mean + 0.10 * F.least(F.lit(1.0), gap)).alias("relevance"),
        F.when(size == 0, 0.0).otherwise(F.size(covered) / size).alias("coverage"),
        F.when(n <= 1, 1.0).when((docs <= 1) & (sections <= F.greatest(F.lit(2), n - 1)), 1.0).when(docs <= 2, 0.75).otherwise(0.55).alias("consistency"),
        (cited / n).alias("citation_support"),
        F.when(F.size("support_sentences") == 0, 0.0).when(size == 0, 0.5).otherwise(F.size(F.array_intersect("terms", X.token_set(F.array_join("support_sentences", " ")))) / size).alias("grounding"),
        gap.alias("top_gap"),
    )
    mix = lambda r, c, k, s, g: r * F.col("relevance") + c * F.col("coverage") + k * F.col("consistency") + s * F.col("citation_support") + g * F.col("grounding")
    sufficiency = (
        F.when((F.col("query_type") == "policy") & (F.col("top_gap") >= 0.30), mix(0.45, 0.15, 0.10, 0.10, 0.20))
        .when(F.col("query_type").isin("comparison", "multi_hop"), mix(0.30, 0.25, 0.20, 0.10, 0.15))
        .otherwise(mix(0.35, 0.25, 0.15, 0.10, 0.15))
    )
    q = q.withColumn("sufficiency", sufficiency)
    decision = (
        F.when(F.col("hits").isNull(), "switch_strategy")
        .when((F.col("sufficiency") >= ANSWER) & (F.col("grounding") >= GROUNDED), "answer")
        .when((F.col("relevance") >= WEAK) & (F.col("coverage") < COVERED), "expand_retrieval")
        .when(F.col("relevance") < WEAK, "switch_strategy")
        .otherwise("abstain")
    )
    scores = ("relevance", "coverage", "consistency", "citation_support", "grounding", "sufficiency")
    return q.withColumn("decision", decision).select(
        "query_id", "question", "query_type", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in scores), "decision",
        F.coalesce(F.transform("chosen", lambda h: h["chunk_id"]), F.array().cast("array<string>")).alias("selected_hit_ids"),
        F.coalesce("support_sentences", F.array().cast("array<string>")).alias("support_sentences"), F.coalesce(top1, F.lit(0.0)).alias("top_score"),
    )


def unchecked(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """What evidence() returns, without a check: each question is to be answered from its first three hits, whatever they are."""
    fields = F.struct("rank", "score", "chunk_id", "text")
    heads = hits.where(F.col("rank") <= 3).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(fields)), 1, 3).alias("hits"))
    q = questions.select("query_id", "question", "query_type").join(heads, "query_id", "left")
    sure = F.when(F.size("hits") > 0, 1.0).otherwise(0.0)
    scores = ("relevance", "coverage", "consistency", "citation_support", "grounding", "sufficiency")
    none = F.array().cast("array<string>")
    return q.select(
        "query_id", "question", "query_type", *(sure.alias(c) for c in scores), F.lit("answer").alias("decision"),
        F.coalesce(F.transform("hits", lambda h: h["chunk_id"]), none).alias("selected_hit_ids"),
        F.coalesce(F.flatten(F.transform("hits", lambda h: F.slice(X.sentences(h["text"]), 1, 1))), none).alias("support_sentences"),
        F.coalesce(F.try_element_at("hits", F.lit(1))["score"], F.lit(0.0)).alias("top_score"),
    )


def answers(assessed: DataFrame, hits: DataFrame, wide: int = 10) -> DataFrame:
    """Answers made of the evidence's sentences, with citations, or the reason why there is none.

    ``assessed`` is what evidence() returns. An answer is the e-mail address
    or the sentence with a number that a question asks for, a list of
    sentences for procedures and comparisons, else the best sentence. It is
    grounded if half of its sentences are in the cited text, or share enough
    words with it.
    """
    fields = F.struct("rank", "score", "chunk_id", "doc_id", "source_name", "section", "text")
    heads = hits.where(F.col("rank") <= wide).groupBy("query_id").agg(F.sort_array(F.collect_list(fields)).alias("hits"))
    a = assessed.join(heads, "query_id", "left").withColumn("terms", X.token_set(F.col("question"))).withColumn("q", F.lower(F.coalesce("question", F.lit(""))))
    own = F.filter("hits", lambda h: F.array_contains("selected_hit_ids", h["chunk_id"]))
    rest = F.filter("hits", lambda h: ~F.array_contains("selected_hit_ids", h["chunk_id"]))
    a = a.withColumn("used", F.coalesce(F.when(F.col("query_type").isin(*WIDE), F.concat(own, rest)).otherwise(own), F.array().cast(heads.schema["hits"].dataType)))
    numeric = X.any_of(F.col("q"), NUMERIC)
    point = lambda test, v: F.when(test, F.lit(v)).otherwise(F.lit(0.0))

    def spans(h: Column, i: Column) -> Column:
        def one(s: Column) -> Column:
            return X.let(F.size(F.array_intersect("terms", X.token_set(s))), lambda overlap: weighed(s, overlap))

        def weighed(s: Column, overlap: Column) -> Column:
            score = overlap + F.greatest(F.lit(0.0), 1.0 - i * 0.15) + point(F.contains("q", F.lit("email")) & F.rlike(s, F.lit(_EMAIL)), 3.0)
            score = score + point(numeric & F.rlike(s, F.lit(_NUMBER)), 4.0) + point(F.contains("q", F.lit("who")) & (X.word_count(s) >= 3), 0.75)
            return F.struct(score.alias("score"), s.alias("sentence"), overlap.alias("overlap"))

        return F.transform(X.sentences(h["text"]), one)

    found = F.filter(F.flatten(F.transform("used", spans)), lambda x: (x["overlap"] > 0) | (x["score"] >= 2.0))
    a = a.withColumn("ranked", best_sentences(found))
    fallback = F.when(F.btrim(F.coalesce(F.try_element_at("used", F.lit(1))["text"], F.lit(""))) != "", F.array(F.btrim(F.try_element_at("used", F.lit(1))["text"]))).otherwise(F.array().cast("array<string>"))
    a = a.withColumn("ranked", F.when(F.size("ranked") > 0, F.col("ranked")).otherwise(fallback))
    first = X.normal(F.try_element_at("ranked", F.lit(1)))
    email = F.regexp_extract(F.array_join("ranked", " "), _EMAIL, 0)
    with_number = F.try_element_at(F.filter("ranked", lambda s: F.rlike(s, F.lit(_NUMBER))), F.lit(1))
    composed = (
        F.when(F.size("ranked") == 0, "I do not have enough grounded evidence to answer.")
        .when(F.contains("q", F.lit("email")) & (email != ""), F.concat(F.lit("The relevant email is "), email, F.lit(". Evidence: "), first))
        .when(numeric & with_number.isNotNull(), X.normal(with_number))
        .when(F.col("query_type") == "procedural", F.array_join(F.transform("ranked", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), X.normal(s))), "\n"))
        .when(F.col("query_type") == "comparison", F.array_join(F.transform("ranked", lambda s: F.concat(F.lit("- "), X.normal(s))), "\n"))
        .otherwise(first)
    )
    partial = "I found partial evidence, but not enough to answer fully"
    refused = (
        F.when((F.col("decision") == "expand_retrieval") & (F.size("support_sentences") > 0), F.concat(F.lit(partial + ": "), F.element_at("support_sentences", 1)))
        .when(F.col("decision") == "expand_retrieval", partial + ".")
        .when(F.col("decision") == "switch_strategy", "I could not find relevant evidence with the current retrieval strategy.")
        .otherwise("I do not have enough grounded evidence to answer.")
    )
    said = F.col("decision") == "answer"
    a = a.withColumn("answer", F.when(said, composed).otherwise(refused)).withColumn("source_text", F.array_join(F.transform("used", lambda h: h["text"]), "\n"))
    long_ones = F.filter(X.sentences(F.col("answer")), lambda s: X.word_count(s) >= 4)
    share = lambda s, source: X.let(X.token_set(s), lambda ts: F.size(F.array_intersect(ts, source["terms"])) / F.greatest(F.size(ts), F.lit(1)))
    half = lambda ls, source: (F.size(ls) == 0) | (F.size(F.filter(ls, lambda s: F.contains(source["fold"], X.match_form(s)) | (share(s, source) >= 0.45))) / F.greatest(F.size(ls), F.lit(1)) >= 0.5)
    source = F.struct(X.match_form(F.col("source_text")).alias("fold"), X.token_set(F.col("source_text")).alias("terms"))
    grounded = ~said | X.contains_text(F.col("source_text"), F.col("answer")) | X.let(source, lambda src: X.let(long_ones, lambda ls: half(ls, src)))
    cite = F.transform("used", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["doc_id"].alias("doc_id"), h["source_name"].alias("source_name"), h["section"].alias("section"), h["score"].alias("score")))
    return a.select(
        *assessed.columns, "answer", cite.alias("citations"), F.when(said, F.col("ranked")).otherwise(F.col("support_sentences")).alias("answer_sentences"),
        grounded.alias("grounded"), F.when(said, "extractive").otherwise(F.col("decision")).alias("answer_type"),
    )


def quality(answered: DataFrame) -> DataFrame:
    """An attempt's quality from 0 to 1, of its evidence's scores, its answer and its citations."""
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    score = (
        0.42 * F.col("sufficiency") + 0.18 * F.col("relevance") + 0.14 * F.col("coverage") + 0.12 * F.col("grounding") + 0.06 * F.least(F.lit(1.0), F.col("top_score"))
        + 0.04 * one(F.size("citations") > 0) + 0.04 * one(F.col("decision") == "answer") + 0.04 * one(F.col("grounded")) - F.when(F.col("decision") != "answer", 0.08).otherwise(0.0)
    )
    return answered.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def can_stop(threshold: float = 0.82) -> Column:
    return (F.col("decision") == "answer") & F.col("grounded") & (F.size("citations") > 0) & (F.col("quality") >= threshold)


def best_attempts(attempts: DataFrame) -> DataFrame:
    """Of each question's attempts (attempt_index, quality, ...) the best one; earlier ones win ties."""
    rest = [c for c in attempts.columns if c != "query_id"]
    key = F.struct(F.round("quality", 4).alias("a"), "sufficiency", "relevance", (-F.col("attempt_index")).alias("b"))
    return attempts.groupBy("query_id").agg(F.max_by(F.struct(*rest), key).alias("x")).select("query_id", "x.*")
