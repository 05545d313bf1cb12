"""Questions to answers: route, plan, retrieve, assess, answer; once, or by several routes until one is good enough."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.operators import qa, retrieval, routing
from lodeline.sources.staging import staged


#: Ways to answer that an evaluation compares.
CONFIGS = (
    "bm25_only", "dense_only", "hybrid_no_routing", "routed_grounded", "adaptive_route_retry", "no_evidence_checker", "no_router", "no_citation_grounding", "no_metadata_filter",
)
#: The plan of configurations that don't plan by type.
FIXED_PLAN = {"top_k": 5, "candidate_k": 60, "bm25_weight": 0.5, "dense_weight": 0.5, "rerank_top_n": 0, "combination": "weighted_sum", "context_window": 0}
FIXED_STRATEGY = {"bm25_only": "bm25", "dense_only": "dense", "hybrid_no_routing": "hybrid", "no_router": "hybrid"}


def config_names(asked: list[str] | None = None) -> list[str]:
    """Names of configurations from items that may hold several between commas; ``all`` stands for all of them."""
    names = [n.strip() for item in asked or ["routed_grounded"] for n in item.split(",") if n.strip()]
    if "all" in names:
        return list(CONFIGS)
    if unknown := [n for n in names if n not in CONFIGS]:
        raise ValueError(f"unknown configurations: {', '.join(unknown)}")
    return list(dict.fromkeys(names))


@dataclass
class Engine:
    """A corpus, its sparse index and, where there are any, vectors: chunk_idx, embedding; and query_id, embedding."""

    corpus: DataFrame
    index: retrieval.SparseIndex
    vectors: DataFrame | None = None
    query_vectors: DataFrame | None = None

    def retrieve(self, planned: DataFrame) -> DataFrame:
        """Ranked hits of questions with a plan (routing.with_plan), one pass for each distinct plan. Without vectors the sparse ranking is all there is."""
        fields = ("strategy", "top_k", "candidate_k", "bm25_weight", "dense_weight", "rerank_top_n", "combination", "context_window", "block_types")
        planned = staged(planned.sparkSession, planned.select("query_id", "question", *fields), "plans")
        out: DataFrame | None = None
        for plan in planned.select(*fields).distinct().orderBy(*fields).collect():
            same = F.lit(True)
            for f in fields:
                same = same & F.col(f).eqNullSafe(F.array(*map(F.lit, plan[f])).cast("array<string>") if f == "block_types" else F.lit(plan[f]))
            asked = planned.where(same).select("query_id", F.col("question").alias("query"))
            hits = self._one(asked, plan)
            out = hits if out is None else out.unionByName(hits)
        return out

    def _one(self, asked: DataFrame, plan) -> DataFrame:  # noqa: ANN001
        keep = max(plan.top_k, plan.candidate_k, plan.rerank_top_n)
        corpus = None
        if plan.block_types:
            none = "cast(null as array<string>)"
            kinds = "array(" + ", ".join(f"'{k}'" for k in plan.block_types) + ")"
            asked = asked.withColumn("filters", F.expr(f"struct({kinds}, {none}, {none}, {none}, {none}, {none}, cast(null as map<string,array<string>>))"))
            corpus = self.corpus
        spark = asked.sparkSession
        ranks = ("query_id", "chunk_idx", "score", "rank")
        sparse = dense = None
        if plan.strategy != "dense":
            sparse = staged(spark, retrieval.bm25(self.index, asked, keep, corpus).select(*ranks), "sparse")
        if plan.strategy != "bm25" and self.vectors is not None and self.query_vectors is not None:
            dense = staged(spark, retrieval.dense(self.vectors, self.query_vectors.join(asked.select("query_id"), "query_id", "left_semi"), keep).select(*ranks), "dense")
        none = asked.where(F.lit(False)).select("query_id", F.lit(0).cast("long").alias("chunk_idx"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        if plan.strategy in ("bm25", "dense"):
            hits = next((found for found in (sparse, dense) if found is not None), none)
        else:
            fuse = retrieval.fuse_rrf if plan.combination == "rrf" else retrieval.fuse_weighted
            fused = fuse(sparse, none if dense is None else dense, (plan.bm25_weight, plan.dense_weight), keep)
            hits = staged(spark, fused.select(*ranks), "fused")
        if plan.strategy == "hybrid_rerank" and plan.rerank_top_n:
            hits = staged(spark, retrieval.rerank(hits, self.corpus, asked, plan.rerank_top_n).select("query_id", "chunk_idx", "score", "rank"), "reranked")
        hits = hits.where(F.col("rank") <= plan.top_k)
        return retrieval.expand_context(hits, self.corpus, plan.context_window).select("query_id", "chunk_idx", "score", "rank")

    def with_text(self, hits: DataFrame) -> DataFrame:
        names = [c if c in self.corpus.columns else None for c in ("chunk_id", "doc_id", "source_name", "section")]
        extra = [F.col(n) if n else F.lit(None).cast("string").alias(c) for n, c in zip(names, ("chunk_id", "doc_id", "source_name", "section"))]
        return self.corpus.select("chunk_idx", "text", *extra).join(retrieval.small(hits), "chunk_idx")

    def answer(self, questions: DataFrame, kind: str | None = None, config: str = "routed_grounded") -> DataFrame:
        """Answers to ``questions`` (query_id, question), typed by the router unless ``kind`` names a column that has the type.

        ``config`` is one of CONFIGS and leaves a part of the engine out, for
        evaluation. Without vectors, ``dense_only`` finds nothing.
        """
        if config not in CONFIGS:
            raise ValueError(f"unknown configuration: {config}")
        if config == "adaptive_route_retry":
            return self.answer_adaptively(questions)
        spark = questions.sparkSession
        routed = F.lit("ambiguous") if config == "no_router" else F.col(kind) if kind else routing.query_type(F.col("question"))
        typed = staged(spark, questions.withColumn("query_type", routed), "typed")
        planned = routing.with_plan(typed)
        if config in FIXED_STRATEGY:
            planned = planned.withColumns({c: F.lit(v) for c, v in {**FIXED_PLAN, "strategy": FIXED_STRATEGY[config]}.items()})
        if config in FIXED_STRATEGY or config == "no_metadata_filter":
            planned = planned.withColumn("block_types", F.array().cast("array<string>"))
        hits = staged(spark, self.with_text(self.retrieve(planned)), "hits")
        check = qa.unchecked if config == "no_evidence_checker" else qa.evidence
        assessed = staged(spark, check(typed.select("query_id", "question", "query_type"), hits), "evidence")
        made = qa.answers(assessed, hits)
        if config == "no_citation_grounding":
            made = made.withColumn("citations", F.slice("citations", 1, 0))
        return qa.quality(made)

    def answer_all(self, questions: DataFrame, configs: list[str]) -> DataFrame:
        """The answers of several configurations, with config_name: what qa_summary takes after a comparison with the expected ones."""
        shared: DataFrame | None = None
        for name in config_names(configs):
            found = staged(questions.sparkSession, self.answer(questions, config=name).withColumn("config_name", F.lit(name)), name)
            shared = found if shared is None else shared.unionByName(found, allowMissingColumns=True)
        return shared

    def answer_adaptively(self, questions: DataFrame, attempts: int = 3, stop: float = 0.82, least: float = 0.40) -> DataFrame:
        """Tries further types for questions whose answer isn't good enough yet, and returns each one's best attempt.

        An answer below the least quality becomes an abstention.
        """
        spark = questions.sparkSession
        todo = staged(spark, questions.withColumn("first", routing.query_type(F.col("question"))), "first")
        todo = staged(spark, todo.withColumn("types", routing.candidate_types(F.col("first"), F.col("question"))).drop("first"), "types")
        made: DataFrame | None = None
        for k in range(max(1, attempts)):
            now = todo.withColumn("kind", F.try_element_at("types", F.lit(k + 1))).where("kind is not null")
            if not now.limit(1).count():
                break
            tried = staged(spark, self.answer(now.select("query_id", "question", "kind"), "kind").withColumn("attempt_index", F.lit(k)), f"attempt{k}")
            made = tried if made is None else made.unionByName(tried)
            todo = todo.join(tried.where(qa.can_stop(stop)).select("query_id"), "query_id", "left_anti")
        best = qa.best_attempts(made)
        weak = (F.col("decision") == "answer") & (F.col("quality") < least)
        counts = made.groupBy("query_id").agg(F.count("*").alias("attempts"))
        refused = F.lit("I do not have enough grounded evidence to answer.")
        return best.withColumn("answer", F.when(weak, refused).otherwise(F.col("answer"))).withColumn("decision", F.when(weak, "abstain").otherwise(F.col("decision"))).join(counts, "query_id")
