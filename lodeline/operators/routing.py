"""Question types and the retrieval plan of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeline.functions import text as X

# Terms by which questions are told apart.
COMPARISON = ("compare", "difference", "different", "differ", "versus", "vs", "than", "so sánh", "khác nhau", "khác biệt", "giữa")
PROCEDURAL = ("procedure", "process", "steps", "apply", "submit", "cách", "làm sao", "quy trình", "thủ tục", "hướng dẫn", "bước", "giai đoạn", "quá trình", "đăng ký học tập", "cộng hoặc trừ")
DEFINITION = ("what is", "meaning", "definition", "là gì", "định nghĩa", "khái niệm", "mô tả", "được gọi", "đặc điểm")
FACTOID = (
    "how many", "how much", "how long", "what score", "what bleu", "what f1", "what beam", "what label", "what value", "where",
    "bao nhiêu", "bao lâu", "khi nào", "từ khi nào", "ai", "gì", "nào", "mấy", "ở đâu", "tối đa", "tối thiểu",
)
POLICY = (
    "policy", "regulation", "rule", "requirement", "must", "may", "eligible", "quy định", "quy chế", "điều kiện", "bắt buộc", "được phép", "không được",
    "có được", "cần đáp ứng", "hậu quả", "trường hợp", "bị hạn chế", "xét công nhận", "nội quy",
)
STRONG_POLICY = ("điều kiện", "được phép", "có được", "cần đáp ứng", "hậu quả", "trường hợp", "bị", "phải", "không được", "xét công nhận")
MULTI_HOP = ("prerequisite", "đồng thời", "vừa", "cùng lúc")
SCIENTIFIC = (
    "paper", "model", "architecture", "attention", "transformer", "encoder", "decoder", "bleu", "f1", "wmt", "feed-forward", "positional encoding",
    "dot-product", "dot products", "square root", "beam size", "label smoothing",
)
STEP_WORDS = ("step", "steps", "buoc", "bước", "procedure", "process")

#: Type, strategy, top_k, candidate_k, sparse and dense weight, rerank_top_n, fusion, context window.
PLANS = (
    ("factoid", "hybrid", 3, 30, 0.45, 0.55, 0, "weighted_sum", 1),
    ("definition", "hybrid", 4, 50, 0.50, 0.50, 0, "weighted_sum", 1),
    ("policy", "hybrid_rerank", 6, 70, 0.60, 0.40, 20, "weighted_sum", 1),
    ("procedural", "hybrid_rerank", 5, 70, 0.45, 0.55, 20, "weighted_sum", 1),
    ("comparison", "hybrid_rerank", 6, 80, 0.45, 0.55, 25, "rrf", 1),
    ("multi_hop", "hybrid", 8, 100, 0.40, 0.60, 0, "rrf", 1),
    ("ambiguous", "hybrid", 4, 60, 0.50, 0.50, 0, "rrf", 1),
    ("factoid/scientific", "hybrid_rerank", 5, 50, 0.45, 0.55, 20, "weighted_sum", 2),
    ("definition/scientific", "hybrid_rerank", 5, 70, 0.50, 0.50, 25, "weighted_sum", 2),
)
#: Types to try after a first one.
FALLBACKS = {
    "factoid": ("definition", "policy", "ambiguous"),
    "definition": ("factoid", "policy", "ambiguous"),
    "policy": ("factoid", "procedural", "ambiguous"),
    "procedural": ("policy", "factoid", "comparison"),
    "comparison": ("multi_hop", "factoid", "policy"),
    "multi_hop": ("comparison", "policy", "factoid"),
    "ambiguous": ("factoid", "policy", "comparison", "procedural"),
}


def query_type(question: Column) -> Column:
    """The first rule that a question meets, by terms in it or words it begins with, decides."""
    q = F.lower(F.btrim(F.coalesce(question, F.lit(""))))
    n = X.word_count(q)
    condition = F.startswith(q, F.lit("điều kiện")) | F.contains(q, F.lit("điều kiện để"))
    return (
        F.when(X.any_of(q, COMPARISON), "comparison")
        .when(X.starts_with_any(q, ("how many ", "how much ", "how long ", "where ")), "factoid")
        .when(X.starts_with_any(q, ("how ",)) | X.any_of(q, PROCEDURAL), "procedural")
        .when(X.starts_with_any(q, ("why ",)), "definition")
        .when(X.starts_with_any(q, ("what does ", "what did ", "what two ", "what three ", "what new ")), "factoid")
        .when(X.starts_with_any(q, ("what are ", "what benefit ")), "definition")
        .when(~condition & X.any_of(q, DEFINITION), "definition")
        .when(X.any_of(q, FACTOID) & ~X.any_of(q, STRONG_POLICY), "factoid")
        .when(X.any_of(q, POLICY), "policy")
        .when(X.any_of(q, MULTI_HOP) & (n > 10), "multi_hop")
        .when(n <= 6, "factoid")
        .otherwise("ambiguous")
    )


def with_plan(questions: DataFrame, kind: str = "query_type", question: str = "question") -> DataFrame:
    """The columns strategy, top_k, candidate_k, weights, rerank_top_n, combination, context_window and block_types for each question."""
    q = F.lower(F.coalesce(F.col(question), F.lit("")))
    key = F.lower(F.btrim(F.col(kind)))
    names = [p[0] for p in PLANS]
    key = F.when(key.isin("factoid", "definition") & X.any_of(q, SCIENTIFIC), F.concat(key, F.lit("/scientific"))).when(key.isin(*names), key).otherwise("ambiguous")
    fields = ("strategy", "top_k", "candidate_k", "bm25_weight", "dense_weight", "rerank_top_n", "combination", "context_window")
    plans = F.create_map(*[x for p in PLANS for x in (F.lit(p[0]), F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, p[1:]))))])
    accented = X.is_accented(F.col(question))
    planned = questions.withColumn("_p", plans[key]).select("*", "_p.*").drop("_p")
    steps = (F.lower(F.btrim(F.col(kind))) == "procedural") & X.any_of(q, STEP_WORDS)
    return (
        planned.withColumn("bm25_weight", F.when(accented, F.greatest("bm25_weight", F.lit(0.72))).otherwise(F.col("bm25_weight")))
        .withColumn("dense_weight", F.when(accented, F.least("dense_weight", F.lit(0.28))).otherwise(F.col("dense_weight")))
        .withColumn("combination", F.when(accented & (F.lower(F.btrim(F.col(kind))) == "comparison"), "weighted_sum").otherwise(F.col("combination")))
        .withColumn("block_types", F.when(steps, F.array(F.lit("list_item"), F.lit("list"), F.lit("paragraph"))).otherwise(F.array().cast("array<string>")))
    )


def candidate_types(first: Column, question: Column) -> Column:
    """The types to try in turn, those that the question's own words suggest ahead of the fallbacks."""
    q = F.lower(F.coalesce(question, F.lit("")))
    fallback = F.create_map(*[x for k, v in FALLBACKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    hint = lambda terms, kind: F.when(X.any_of(q, terms), F.array(F.lit(kind))).otherwise(F.array().cast("array<string>"))
    kind = F.coalesce(F.nullif(F.lower(F.btrim(first)), F.lit("")), F.lit("ambiguous"))
    return F.array_distinct(
        F.concat(
            F.array(kind),
            hint(("quy định", "điều kiện", "bắt buộc", "policy", "must"), "policy"),
            hint(("quy trình", "bước", "thủ tục", "how", "steps"), "procedural"),
            hint(("khác", "so sánh", "compare", "difference"), "comparison"),
            F.coalesce(fallback[kind], fallback["ambiguous"]),
        )
    )
