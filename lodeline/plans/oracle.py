"""SQL for the same results as ``queries``, where SQL can express them."""

from __future__ import annotations

from lodeline.functions.text import STOPWORDS
from lodeline.plans.queries import QUESTIONS

_SPARSE = r"""
words AS (SELECT doc_id AS chunk_idx, regexp_extract_all(lower('paragraph' || chr(10) || text), '[\p{L}\p{N}]+') AS w FROM documents),
sized AS (SELECT chunk_idx, len(w) AS dl, w FROM words),
stats AS (SELECT count(*) AS n, avg(dl) AS mean FROM sized),
postings AS (SELECT chunk_idx, dl, term, count(*) AS tf FROM (SELECT chunk_idx, dl, unnest(w) AS term FROM sized) GROUP BY ALL),
weights AS (SELECT term, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
terms AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM weights) ELSE raw END AS idf FROM weights),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT query_id, chunk_idx, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT mean FROM stats)))) AS raw
  FROM asked JOIN terms USING (term) JOIN postings USING (term) GROUP BY query_id, chunk_idx),
positive AS (SELECT * FROM scores WHERE raw > 0)
"""


def _bm25(keep: int, source: str = "positive") -> str:
    return f"""
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_idx) AS rank FROM {source}),
hits AS (SELECT query_id, chunk_idx, raw, raw / max(raw) OVER (PARTITION BY query_id) AS score, rank FROM ranks WHERE rank <= {keep})"""


BM25 = f"WITH {_SPARSE}, {_bm25(10)} SELECT query_id, chunk_idx, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM hits"

BM25_FILTERED = f"""WITH {_SPARSE},
allowed AS (SELECT p.* FROM positive p JOIN documents d ON d.doc_id = p.chunk_idx WHERE lower(trim(d.lang)) IN ('fr', 'de')), {_bm25(5, "allowed")}
SELECT query_id, chunk_idx, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM hits"""

DENSE = """
WITH unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS length FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_idx, list_dot_product(q.v, c.v) / q.length / c.length AS cosine
  FROM unit q, unit c WHERE q.vec_id % 50 = 0),
ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, chunk_idx) AS rank FROM pairs)
SELECT query_id, chunk_idx, round(greatest(0.0, least(1.0, (cosine + 1) / 2)), 6) AS score, rank FROM ranks WHERE rank <= 10
"""

_TWO = f"""WITH {_SPARSE}, {_bm25(50)},
terms2 AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n FROM asked),
shared AS (SELECT query_id, chunk_idx, count(*) / CAST(max(n) AS DOUBLE) AS score FROM terms2 JOIN postings USING (term) GROUP BY query_id, chunk_idx),
ranks2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM shared),
others AS (SELECT * FROM ranks2 WHERE rank <= 50)"""


def _min_max(name: str, of: str) -> str:
    return f"""{name} AS (SELECT query_id, chunk_idx, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w)
  WHEN score > 0 THEN 1.0 ELSE 0.0 END AS mm FROM {of} WINDOW w AS (PARTITION BY query_id))"""


FUSE_WEIGHTED = f"""{_TWO}, {_min_max("a", "hits")}, {_min_max("b", "others")},
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx, 0.6 * coalesce(a.mm, 0.0) + 0.4 * coalesce(b.mm, 0.0) AS score
  FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.chunk_idx = b.chunk_idx),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM fused)
SELECT query_id, chunk_idx, round(score, 6) AS score, rank FROM final WHERE rank <= 10"""

FUSE_RRF = f"""{_TWO},
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_idx, b.chunk_idx) AS chunk_idx, coalesce(0.6 / (60 + a.rank), 0.0) + coalesce(0.4 / (60 + b.rank), 0.0) AS raw
  FROM hits a FULL OUTER JOIN others b ON a.query_id = b.query_id AND a.chunk_idx = b.chunk_idx),
scaled AS (SELECT query_id, chunk_idx, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM fused),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx) AS rank FROM scaled)
SELECT query_id, chunk_idx, round(score, 6) AS score, rank FROM final WHERE rank <= 10"""

CONTEXT = f"""WITH {_SPARSE}, {_bm25(5)},
near AS (
  SELECT query_id, rank * 3 + o AS turn, chunk_idx + s AS chunk_idx, greatest(0.0, score - 0.01 * abs(s)) AS score, s <> 0 AS is_neighbour
  FROM hits, (VALUES (0, 0), (1, -1), (2, 1)) AS e(o, s)),
present AS (SELECT n.* FROM near n JOIN documents d ON d.doc_id = n.chunk_idx),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_idx ORDER BY turn) AS k FROM present)
SELECT query_id, chunk_idx, round(score, 6) AS score, is_neighbour, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS rank FROM firsts WHERE k = 1"""

EVAL = f"""WITH {_SPARSE}, {_bm25(10)},
gold AS (SELECT item_id AS query_id, doc_id AS chunk_idx FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))),
wanted AS (SELECT query_id, count(*) AS relevant FROM gold GROUP BY query_id),
found AS (SELECT query_id, count(*) AS n, min(rank) AS first_match_rank, sum(1 / log2(rank + 1)) AS dcg FROM hits JOIN gold USING (query_id, chunk_idx) GROUP BY query_id),
ideal AS (SELECT query_id, sum(1 / log2(r + 1)) AS idcg FROM wanted, range(1, 11) AS g(r) WHERE r <= relevant GROUP BY query_id)
SELECT query_id, relevant, first_match_rank, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(n, 0) / CAST(relevant AS DOUBLE), 6) AS recall,
       round(coalesce(1.0 / first_match_rank, 0.0), 6) AS mrr, round(coalesce(dcg, 0.0) / idcg, 6) AS ndcg
FROM wanted JOIN ideal USING (query_id) LEFT JOIN found USING (query_id)"""

_CASES = f"""{_TWO},
names AS (SELECT doc_id AS chunk_idx, concat_ws(':', source, doc_id) AS chunk_id, source, text FROM documents),
held AS (SELECT item_id AS query_id, chunk_id FROM benchmark b JOIN names d ON item_id % 2 = 0 AND contains(lower(d.text), lower(b.text))),
sizes AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 1 + (SELECT count(DISTINCT chunk_id) FROM held h WHERE h.query_id = item_id) ELSE 1 END AS relevant FROM benchmark),
tops AS (SELECT 'bm25' AS strategy, query_id, chunk_idx, rank, score FROM hits WHERE rank <= 10 UNION ALL SELECT 'overlap', query_id, chunk_idx, rank, score FROM others WHERE rank <= 10),
judged AS (
  SELECT t.*, n.chunk_id, CASE WHEN query_id % 2 = 0 THEN EXISTS (SELECT 1 FROM held h WHERE h.query_id = t.query_id AND h.chunk_id = n.chunk_id)
    ELSE coalesce(trim(b.text) <> '' AND contains(lower(n.text), lower(trim(b.text))), false) AND (query_id % 4 <> 3 OR coalesce(n.source, '') = 'src3') END AS ok
  FROM tops t JOIN names n USING (chunk_idx) JOIN benchmark b ON b.item_id = t.query_id),
per AS (
  SELECT strategy, query_id, min(rank) FILTER (WHERE ok) AS first_match_rank, sum(1 / log2(rank + 1)) FILTER (WHERE ok) AS dcg, count(DISTINCT chunk_id) FILTER (WHERE ok) AS found, count(*) AS n,
    max(chunk_id) FILTER (WHERE rank = 1) AS top_id, max(score) FILTER (WHERE rank = 1) AS top_score FROM judged GROUP BY ALL),
rows_ AS (
  SELECT k.strategy, s.query_id, first_match_rank IS NOT NULL AS hit, CASE WHEN s.query_id % 2 = 0 THEN coalesce(found, 0) / CAST(relevant AS DOUBLE) WHEN first_match_rank IS NULL THEN 0.0 ELSE 1.0 END AS recall,
    coalesce(1.0 / first_match_rank, 0.0) AS mrr, coalesce(dcg, 0.0) / (SELECT sum(1 / log2(r + 1)) FROM range(1, 11) AS g(r) WHERE r <= relevant) AS ndcg, first_match_rank, coalesce(n, 0) AS retrieval_count, top_id, top_score
  FROM sizes s CROSS JOIN (VALUES ('bm25'), ('overlap')) AS k(strategy) LEFT JOIN per USING (strategy, query_id))"""
CASE_ROWS = f"""{_CASES}
SELECT strategy, query_id, hit, coalesce(first_match_rank, 0) AS first_match_rank, retrieval_count, top_id AS top_hit_chunk_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(top_score, 6) AS top_hit_score FROM rows_"""
STRATEGIES = f"""{_CASES}
SELECT strategy, count(*) AS query_count, round(avg(hit::INT), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(retrieval_count), 6) AS retrieval_count
FROM rows_ GROUP BY strategy"""

_LINES = r"""
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS reading_order FROM documents),
lines AS (SELECT doc_id, source, reading_order, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM raw_lines WHERE trim(line) <> '')
"""
_REPEATED = f"""{_LINES},
shaped AS (SELECT source, doc_id, lower(text) AS norm, reading_order = 0 AS edge FROM lines),
totals AS (SELECT source, count(DISTINCT doc_id) AS all_pages FROM shaped GROUP BY source),
counted AS (SELECT source, norm, count(DISTINCT doc_id) AS pages, CAST(sum(CASE WHEN edge THEN 1 ELSE 0 END) AS BIGINT) AS edge_hits FROM shaped WHERE norm <> '' AND length(norm) <= 220 GROUP BY source, norm),
repeated AS (SELECT source, norm, pages, edge_hits FROM counted JOIN totals USING (source) WHERE pages >= 3 AND (pages / CAST(all_pages AS DOUBLE) >= 0.6 OR edge_hits >= 2))"""
REPEATED_LINES = f"WITH {_REPEATED} SELECT source AS doc_id, norm, pages, edge_hits FROM repeated"
REMOVE_REPEATED = f"""WITH {_REPEATED}
SELECT s.source AS doc_id, count(*) AS kept_lines FROM shaped s LEFT JOIN repeated r ON s.source = r.source AND s.norm = r.norm WHERE r.norm IS NULL GROUP BY s.source"""

_UPPER = r"CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Lu}')) / CAST(len(regexp_extract_all(text, '\p{L}')) AS DOUBLE) ELSE 0.0 END"
_LEGAL = r"'(?i)^(chương|phần|mục|điều|khoản|điểm)\s+[0-9a-z]+[.:\-]?\s*'"
_TYPED = rf"""{_LINES},
measured AS (SELECT *, {_UPPER} AS upper_share, len(regexp_extract_all(text, '\S+')) AS n FROM lines),
typed AS (
  SELECT *, CASE
    WHEN length(text) <= 180 AND regexp_matches(text, {_LEGAL}) THEN 'heading'
    WHEN length(text) <= 180 AND regexp_matches(text, '^\d+(\.\d+)*\.?\s+\S+') AND NOT regexp_matches(text, '^\d+\s+\S+') THEN 'heading'
    WHEN length(text) <= 180 AND NOT regexp_matches(text, '^\d+(\.\d+)*\.?\s+\S+') AND (upper_share > 0.85 AND n <= 12
         OR n <= 10 AND NOT text LIKE '%.' AND NOT text LIKE '%;' AND NOT contains(text, ':') AND length(text) <= 100) THEN 'heading'
    WHEN regexp_matches(text, '^(\d+[.)]|[a-zA-Z][.)]|[ivxlcdmIVXLCDM]+[.)]|[•●▪■*-])\s+\S+') OR regexp_matches(text, '^\d+\s+\S+') THEN 'list_item'
    WHEN regexp_matches(text, '^[^:\n]{{1,80}}:\s+\S+') OR regexp_matches(lower(text), '^(tên học phần|mã học phần|giảng viên|email|thời gian|địa chỉ|số điện thoại|hạn nộp hồ sơ|ngôn ngữ|phiên bản):') THEN 'metadata'
    ELSE 'paragraph' END AS block_type
  FROM measured)"""
CLASSIFY = f"WITH {_TYPED} SELECT doc_id, block_type, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM typed GROUP BY doc_id, block_type"
NOISE = rf"""WITH {_TYPED}
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '^\d{{1,3}}$') OR length(text) = 1 AND NOT regexp_matches(text, '[\p{{L}}\p{{N}}]')
  OR upper_share >= 0.95 AND n <= 3 AND NOT regexp_matches(text, {_LEGAL}) AND length(text) <= 12) AS noise, count(*) AS lines
FROM typed GROUP BY doc_id"""
MARKDOWN = rf"""WITH {_TYPED}
SELECT doc_id, CAST(reading_order AS INTEGER) AS reading_order, CASE block_type WHEN 'heading' THEN '## ' || text
  WHEN 'list_item' THEN '- ' || CASE WHEN regexp_matches(text, '^\d+[.)]\s+') THEN regexp_replace(text, '^\d+[.)]\s+', '')
    WHEN regexp_matches(text, '^[a-zA-Z][.)]\s+') THEN regexp_replace(text, '^[a-zA-Z][.)]\s+', '')
    WHEN regexp_matches(text, '^[ivxlcdmIVXLCDM]+[.)]\s+') THEN regexp_replace(text, '^[ivxlcdmIVXLCDM]+[.)]\s+', '')
    WHEN regexp_matches(text, '^[•●▪■*-]\s+') THEN regexp_replace(text, '^[•●▪■*-]\s+', '') ELSE regexp_replace(text, '^\d+\s+', '') END
  ELSE text END AS markdown FROM typed"""

HTML = r"""
WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li)>')) AS raw FROM pages),
shaped AS (SELECT page_id AS doc_id, regexp_extract(raw, '^<(h[1-6]|p|li)', 1) AS kind, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM found)
SELECT doc_id, CASE WHEN kind LIKE 'h%' THEN 'heading' WHEN kind = 'li' THEN 'list_item' ELSE 'paragraph' END AS block_type, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars
FROM shaped WHERE text <> '' GROUP BY ALL
"""

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))
TOKEN_F1 = rf"""
WITH turns AS (
  SELECT conv_id, turn, list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS w FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.w AS p, b.w AS g FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
pc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS t FROM pairs) GROUP BY ALL),
gc AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS t FROM pairs) GROUP BY ALL),
common AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS k FROM pc JOIN gc USING (conv_id, turn, t) GROUP BY conv_id, turn)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN len(p) = 0 OR len(g) = 0 OR k IS NULL THEN 0.0 ELSE 2.0 * k / (len(p) + len(g)) END, 6) AS f1
FROM pairs LEFT JOIN common USING (conv_id, turn)"""

PERCENTILES = """SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY lang"""

_QUALITY = r"""
stripped AS (SELECT doc_id, source, text AS original, n_chars, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
cut AS (SELECT *, greatest(length(t), 1) AS n, list_filter(list_transform(regexp_split_to_array(t, '\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM stripped),
quality AS (
  SELECT *, CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0,
    0.25 * len(regexp_extract_all(t, '[^\p{C}\p{Zl}\p{Zp}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]')) / n + 0.25 * len(regexp_extract_all(t, '[\p{L}\p{N}]')) / n
    + 0.10 * least(len(regexp_extract_all(t, '\s')) / CAST(n AS DOUBLE) / 0.15, 1.0) - 0.30 * len(regexp_extract_all(t, '[@#$%^&*_+=~`|<>\[\]{}]')) / n
    - 0.50 * least(len(regexp_extract_all(t, '\?')) / CAST(n AS DOUBLE) * 10, 0.5) - 0.20 * least(len(regexp_extract_all(t, '[qxwvQXWV]')) / CAST(n AS DOUBLE) * 5, 0.2)
    + 0.15 * least(list_sum(list_transform(ls, lambda x: length(x))) / CAST(len(ls) AS DOUBLE) / 40.0, 1.0)
    - 0.40 * len(list_filter(ls, lambda x: length(x) <= 5)) / len(ls) - 0.30 * len(list_filter(ls, lambda x: length(x) = 1)) / len(ls))) END AS text_quality
  FROM cut)
"""
PROBE = f"""WITH {_QUALITY},
pages AS (SELECT source, length(original) AS chars, len(list_filter(string_split(original, chr(10)), lambda x: trim(x) <> '')) AS blocks, text_quality FROM quality),
each AS (
  SELECT source, count(*) AS page_count, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(blocks) AS BIGINT) AS total_blocks,
         count(*) FILTER (WHERE chars > 50) / CAST(count(*) AS DOUBLE) AS layer, count(*) FILTER (WHERE chars < 20 AND blocks <= 3) / CAST(count(*) AS DOUBLE) AS scan, avg(text_quality) AS q
  FROM pages GROUP BY source)
SELECT source AS doc_id, page_count, total_chars, total_blocks, round(layer, 6) AS text_layer_ratio, round(scan, 6) AS likely_scanned_ratio, round(q, 6) AS avg_text_quality,
       CASE WHEN scan >= 0.8 AND layer < 0.3 THEN 'ocr' WHEN scan >= 0.4 AND layer >= 0.3 THEN 'mixed' WHEN layer >= 0.7 AND total_blocks / CAST(page_count AS DOUBLE) >= 12 THEN 'layout' ELSE 'text' END AS mode
FROM each"""

_GRADED = f"{_QUALITY}, graded AS (SELECT l.quality AS truth, CASE WHEN q.text_quality >= 0.55 THEN 1 ELSE 0 END AS predicted, q.n_chars, q.text_quality FROM quality q JOIN labels l USING (doc_id))"
CONFUSION = f"WITH {_GRADED} SELECT truth, predicted, count(*) AS n FROM graded GROUP BY ALL"
CLASS_F1 = f"""WITH {_GRADED},
sides AS (SELECT truth AS label, true AS t, truth = predicted AS ok FROM graded UNION ALL SELECT predicted, false, truth = predicted FROM graded),
c AS (SELECT label, count(*) FILTER (WHERE t AND ok) AS tp, count(*) FILTER (WHERE NOT t AND NOT ok) AS fp, count(*) FILTER (WHERE t AND NOT ok) AS fn FROM sides GROUP BY label)
SELECT label, tp, fp, fn, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0.0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0.0), 6) AS recall,
       round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0.0), 6) AS f1 FROM c"""
FEATURES = f"""WITH {_GRADED},
long AS (SELECT truth AS label, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) AS value FROM graded UNION ALL SELECT truth, 'text_quality', text_quality FROM graded)
SELECT label, feature, count(value) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END, 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS largest
FROM long GROUP BY label, feature"""


def _any(terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(q, '{t}')" for t in terms) + ")"


def _routed() -> str:
    from lodeline.operators import routing as R

    starts = lambda *ts: "(" + " OR ".join(f"starts_with(q, '{t}')" for t in ts) + ")"
    rows = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in QUESTIONS)
    return f"""asked AS (
  SELECT query_id, lower(trim(coalesce(question, ''))) AS q, question FROM (
    SELECT 'q' || n AS query_id, question FROM (VALUES {rows}) AS v(n, question) UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT concat_ws('-', 'c', conv_id, turn), text FROM conversations)),
routed AS (SELECT *, CASE WHEN {_any(R.COMPARISON)} THEN 'comparison' WHEN {starts("how many ", "how much ", "how long ", "where ")} THEN 'factoid'
  WHEN {starts("how ")} OR {_any(R.PROCEDURAL)} THEN 'procedural' WHEN {starts("why ")} THEN 'definition'
  WHEN {starts("what does ", "what did ", "what two ", "what three ", "what new ")} THEN 'factoid' WHEN {starts("what are ", "what benefit ")} THEN 'definition'
  WHEN NOT starts_with(q, 'điều kiện') AND NOT contains(q, 'điều kiện để') AND {_any(R.DEFINITION)} THEN 'definition'
  WHEN {_any(R.FACTOID)} AND NOT {_any(R.STRONG_POLICY)} THEN 'factoid' WHEN {_any(R.POLICY)} THEN 'policy'
  WHEN {_any(R.MULTI_HOP)} AND len(regexp_extract_all(q, '\\S+')) > 10 THEN 'multi_hop' WHEN len(regexp_extract_all(q, '\\S+')) <= 6 THEN 'factoid' ELSE 'ambiguous' END AS query_type FROM asked)"""


def _route() -> str:
    from lodeline.operators import routing as R

    hints = "".join(
        f" || CASE WHEN {_any(terms)} THEN ['{kind}'] ELSE [] END"
        for terms, kind in (
            (("quy định", "điều kiện", "bắt buộc", "policy", "must"), "policy"), (("quy trình", "bước", "thủ tục", "how", "steps"), "procedural"), (("khác", "so sánh", "compare", "difference"), "comparison"),
        )
    )
    rows = ", ".join(f"('{k}', {list(v)})" for k, v in R.FALLBACKS.items())
    return f"""WITH {_routed()},
fallbacks AS (SELECT * FROM (VALUES {rows}) AS v(query_type, further)),
listed AS (SELECT query_id, query_type, [query_type]{hints} || coalesce(further, (SELECT further FROM fallbacks WHERE query_type = 'ambiguous')) AS l FROM routed LEFT JOIN fallbacks USING (query_type)),
places AS (SELECT query_id, query_type, unnest(l) AS kind, generate_subscripts(l, 1) AS place FROM listed),
firsts AS (SELECT query_id, query_type, kind, min(place) AS place FROM places GROUP BY ALL)
SELECT query_id, query_type, string_agg(kind, ',' ORDER BY place) AS candidates FROM firsts GROUP BY query_id, query_type"""


def _plan() -> str:
    from lodeline.operators import routing as R

    rows = ", ".join(str(p) for p in R.PLANS)
    return f"""WITH {_routed()},
plans AS (SELECT * FROM (VALUES {rows}) AS v(kind, strategy, top_k, candidate_k, bm25_weight, dense_weight, rerank_top_n, combination, context_window)),
keyed AS (SELECT *, CASE WHEN query_type IN ('factoid', 'definition') AND {_any(R.SCIENTIFIC)} THEN query_type || '/scientific' ELSE query_type END AS kind, regexp_matches(q, '[à-ỹ]') AS accented FROM routed)
SELECT query_id, query_type, strategy, CAST(top_k AS INTEGER) AS top_k, CAST(candidate_k AS INTEGER) AS candidate_k, CAST(CASE WHEN accented THEN greatest(bm25_weight, 0.72) ELSE bm25_weight END AS DOUBLE) AS bm25_weight,
  CAST(CASE WHEN accented THEN least(dense_weight, 0.28) ELSE dense_weight END AS DOUBLE) AS dense_weight, CAST(rerank_top_n AS INTEGER) AS rerank_top_n,
  CASE WHEN accented AND query_type = 'comparison' THEN 'weighted_sum' ELSE combination END AS combination, CAST(context_window AS INTEGER) AS context_window,
  CASE WHEN query_type = 'procedural' AND {_any(R.STEP_WORDS)} THEN 'list_item,list,paragraph' ELSE '' END AS block_types
FROM keyed JOIN plans USING (kind)"""


_BOXES = """boxes AS (
  SELECT CAST(doc_id // 16 AS VARCHAR) AS entry_id, CAST(doc_id % 16 AS INTEGER) AS region, coalesce(lang, '-') AS block_type, coalesce(n_chars, 0) AS chars, 40.0::DOUBLE + coalesce(n_chars, 0) % 60 AS height
  FROM documents)"""
#: Boxes of a region overlap by their height less the shift between them; no other region is near, and the nearest prediction of the class is taken.
DETECTION = f"""WITH {_BOXES},
found AS (
  SELECT entry_id, region, block_type, 2 * region AS pred, (chars % 29)::DOUBLE AS down, height FROM boxes WHERE chars % 7 > 0
  UNION ALL SELECT entry_id, region, CASE WHEN chars % 5 = 0 THEN 'other' ELSE block_type END, 2 * region + 1, (chars % 17)::DOUBLE, height FROM boxes WHERE chars % 3 = 0),
near AS (SELECT block_type, entry_id, region FROM found f JOIN boxes b USING (entry_id, region, block_type) WHERE (f.height - down) / (f.height + down) >= 0.5 GROUP BY ALL),
sides AS (
  SELECT block_type, 1 AS t, 0 AS p, 0 AS m FROM boxes UNION ALL SELECT block_type, 0, 1, 0 FROM found UNION ALL SELECT block_type, 0, 0, 1 FROM near),
c AS (SELECT block_type, CAST(sum(m) AS BIGINT) AS tp, CAST(sum(p) - sum(m) AS BIGINT) AS fp, CAST(sum(t) - sum(m) AS BIGINT) AS fn FROM sides GROUP BY ROLLUP (block_type))
SELECT block_type, tp, fp, fn, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0.0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0.0), 6) AS recall,
       round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0.0), 6) AS f1 FROM c"""
#: Of three boxes the first stays, the second if it is far from it, the third if it is far from those that stay.
REGIONS = f"""WITH {_BOXES},
shifts AS (SELECT *, (chars % 13)::DOUBLE AS a, (chars % 11)::DOUBLE AS b FROM boxes),
tests AS (SELECT *, (height - a) / (height + a) < 0.75 AS second, (height - b) / (height + b) < 0.75 AS apart, (height - a - b) / (height + a + b) < 0.75 AS far FROM shifts)
SELECT entry_id AS page, 3 * region AS region, block_type, 0.9::DOUBLE AS score FROM tests
UNION ALL SELECT entry_id, 3 * region + 1, block_type, 0.8 FROM tests WHERE second
UNION ALL SELECT entry_id, 3 * region + 2, block_type, 0.7 FROM tests WHERE far AND (apart OR NOT second)"""

STABILITY = """WITH docs AS (SELECT doc_id % 5 AS run, n_chars, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source FROM documents),
rates AS (
  SELECT run, avg(CASE WHEN n_chars >= 20 THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN n_chars >= 400 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN n_chars >= 1500 THEN 1.0 ELSE 0.0 END) AS b, avg(n_chars) / 1000 AS l
  FROM docs GROUP BY run),
counts AS (SELECT run, 'b' AS side, lang AS name, count(*) AS n FROM docs GROUP BY run, lang UNION ALL SELECT run, 'r', source, count(*) FROM docs GROUP BY run, source),
best AS (SELECT DISTINCT side, name FROM (SELECT *, row_number() OVER (PARTITION BY run, side ORDER BY n DESC, name) AS place FROM counts) WHERE place = 1)
SELECT count(*) AS runs, round(min(s), 6) AS success_rate_min, round(max(s), 6) AS success_rate_max, round(min(a), 6) AS iou50_micro_f1_min, round(max(a), 6) AS iou50_micro_f1_max, round(min(b), 6) AS iou75_micro_f1_min,
  round(max(b), 6) AS iou75_micro_f1_max, round(min(l), 6) AS latency_p95_sec_min, round(max(l), 6) AS latency_p95_sec_max,
  (SELECT string_agg(name, ',' ORDER BY name) FROM best WHERE side = 'b') AS dominant_backends, (SELECT string_agg(name, ',' ORDER BY name) FROM best WHERE side = 'r') AS dominant_routes,
  (SELECT count(*) = 1 FROM best WHERE side = 'b') AS backend_consistent, (SELECT count(*) = 1 FROM best WHERE side = 'r') AS route_consistent FROM rates"""

MARKDOWN_BLOCKS = r"""
WITH parts AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\. |\n')) AS x, generate_subscripts(string_split_regex(coalesce(text, ''), '\. |\n'), 1) - 1 AS i FROM documents),
shaped AS (
  SELECT doc_id, string_agg(CASE WHEN i % 13 = 0 THEN '## ' || x WHEN i % 13 = 3 THEN '  ' WHEN i % 13 = 4 THEN '- ' || x WHEN i % 13 = 6 THEN '| ' || x || ' | b |' WHEN i % 13 = 7 THEN '|---|:-:|'
    WHEN i % 13 = 8 OR i % 26 = 9 THEN '# c | ' || x WHEN i % 13 = 11 THEN x || ' | no rule' ELSE x END, chr(10) ORDER BY i) AS markdown FROM parts GROUP BY doc_id),
raws AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS raw, generate_subscripts(string_split(markdown, chr(10)), 1) AS line FROM shaped),
lines AS (SELECT doc_id, line, regexp_replace(raw, '\s+$', '') AS raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM raws),
tested AS (
  SELECT *, contains(s, '|') AS bar, regexp_matches(s, '^#{1,6}\s+') AS heading, regexp_matches(s, '^[-*+]\s+') AS item,
    lead(s) OVER w AS nxt, sum(CASE WHEN contains(s, '|') THEN 0 ELSE 1 END) OVER w AS run FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
starts AS (
  SELECT doc_id, run, min(line) AS first FROM tested
  WHERE bar AND NOT heading AND NOT item AND contains(nxt, '|') AND contains(nxt, '-') AND replace(replace(replace(replace(nxt, '|', ''), ':', ''), '-', ''), ' ', '') = '' GROUP BY ALL),
kinds AS (
  SELECT t.*, CASE WHEN bar AND line >= first THEN 'table' || run WHEN s = '' THEN 'blank' WHEN heading THEN 'heading' WHEN item THEN 'list_item' ELSE 'paragraph' END AS kind
  FROM tested t LEFT JOIN starts USING (doc_id, run)),
blocks AS (
  SELECT *, sum(CASE WHEN kind IN ('blank', 'heading', 'list_item') OR kind IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM kinds)),
joined AS (SELECT doc_id, block, regexp_replace(kind, '[0-9]+$', '') AS block_type, regexp_replace(string_agg(raw, chr(10) ORDER BY line), '^\s+|\s+$', '', 'g') AS whole FROM blocks WHERE kind <> 'blank' GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INTEGER) AS reading_order, block_type, CASE WHEN block_type = 'heading' THEN CAST(length(regexp_extract(whole, '^#+')) AS INTEGER) END AS level,
  md5(CASE block_type WHEN 'heading' THEN regexp_replace(whole, '^#{1,6}\s+', '') WHEN 'list_item' THEN regexp_replace(whole, '^[-*+]\s+', '') ELSE whole END) AS text_md5 FROM joined"""

NORMAL_BLOCKS = """
SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'paragraph' ELSE ['heading', 'heading', 'list_item', 'table', 'caption', 'figure', 'metadata', 'metadata', 'figure', 'paragraph', 'paragraph'][CAST(doc_id % 11 AS INTEGER) + 1] END AS block_type,
  md5(CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN lang ELSE text END) AS markdown_md5, CASE WHEN doc_id % 3 = 0 THEN 7 ELSE doc_id END AS reading_order FROM documents"""

ROUTES = r"""
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'table' ELSE CASE WHEN doc_id % 4 > 1 AND regexp_matches(coalesce(text, ''), '\S') THEN 'text' WHEN doc_id % 6 = 1 THEN 'placeholder' ELSE 'ocr' END END AS route FROM documents"""

EXTRACTORS = r"""
WITH docs AS (SELECT doc_id, coalesce(n_chars, 0) AS size, coalesce(text, '') AS text, (coalesce(n_chars, 0) % 10) / 10 AS r, doc_id % 3 AS images, doc_id % 4 AS mode FROM documents),
flags AS (
  SELECT *, mode = 2 AND r >= 0.8 AND 1 - r < 0.25 AND images >= 1 AS skips, images >= 1 AND 1 - r < 0.25 AND r >= 0.5 AS prefers,
    len(list_filter(string_split(text, '. '), lambda x: length(x) > 60)) AS longs FROM docs),
layouts AS (SELECT *, CASE WHEN skips THEN 'model_routed,model_layout' ELSE 'model_routed,model_layout,layout' END AS l FROM flags),
plans AS (
  SELECT *, CASE WHEN mode = 2 AND prefers THEN l || ',ocr,text' WHEN mode = 2 THEN 'ocr,text,' || l WHEN mode = 1 OR (mode = 3 AND prefers) THEN l || ',text,ocr' ELSE 'text,' || l || ',ocr' END AS plan FROM layouts),
steps AS (SELECT *, unnest(string_split(plan, ',')) AS extractor, generate_subscripts(string_split(plan, ','), 1) - 1 AS step FROM plans),
tests AS (
  SELECT *, CASE extractor WHEN 'text' THEN length(text) >= 50 WHEN 'ocr' THEN regexp_matches(text, '\S')
    ELSE longs > 1 AND (size % 3 = 0 OR longs >= 5) AND (extractor = 'layout' OR size % 4 > 0) AND (extractor <> 'model_routed' OR size % 5 > 0) END AS valid FROM steps)
SELECT doc_id, plan, arg_min(extractor, step) FILTER (WHERE valid) AS extractor, CAST(coalesce(min(step) FILTER (WHERE valid), count(*)) AS INTEGER) AS tried FROM tests GROUP BY doc_id, plan"""

OCR_TABLES = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS n FROM cut),
placed AS (SELECT doc_id, n // 40 AS page_index, n % 40 AS line, text, 20.0::DOUBLE + (n % 40) * 12 + ((n % 40) // 5) * 30 AS y0 FROM lines WHERE trim(text) <> ''),
rated AS (
  SELECT *, y0 + 10 AS y1, trim(text) AS s, len(regexp_extract_all(text, '\S+')) AS w, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS known,
    len(regexp_extract_all(text, '\p{Nd}')) AS digits, len(regexp_extract_all(text, '\p{Nd}+(?:[.,]\p{Nd}+)?')) >= 2 AS numeric FROM placed),
kinds AS (
  SELECT *, (w > 0 AND (w <= 3 OR (w <= 8 AND regexp_matches(text, '\b\d+(?:[.,]\d+)?\b')))) OR regexp_matches(s, '^(- |\* |• )')
    OR (length(s) > 0 AND length(s) < 100 AND ((upper(s) = s AND lower(s) <> s) OR regexp_matches(s, '^[1-5]\.'))) AS structured FROM rated),
windows AS (
  SELECT *, y0 - lag(y1) OVER o AS gap, row_number() OVER o AS nth, count(*) OVER p AS total, avg(structured::INT) OVER p AS page_structured
  FROM kinds WINDOW p AS (PARTITION BY doc_id, page_index), o AS (PARTITION BY doc_id, page_index ORDER BY y0)),
clustered AS (SELECT *, sum(coalesce(gap > 18, false)::INT) OVER (PARTITION BY doc_id, page_index ORDER BY y0) AS cluster FROM windows WHERE total >= 6),
groups AS (
  SELECT doc_id, page_index, cluster, count(*) AS n_lines, any_value(total) AS total, min(y0) AS y0, max(y1) AS y1, avg(CASE WHEN known > 0 THEN digits / known ELSE 0 END) AS d,
    avg(numeric::INT) AS m, avg(structured::INT) AS t, string_agg(text, chr(10) ORDER BY nth) AS text FROM clustered GROUP BY ALL),
chosen AS (
  SELECT *, 0.5 * n_lines + 12 * d + 10 * m + 8 * t + 2 * (400 / 600) + 4 * n_lines / total AS rated FROM groups
  WHERE n_lines >= 4 AND (y1 - y0) / 300 >= 0.18 AND (d >= 0.10 OR m >= 0.35 OR t >= 0.65)),
whole AS (
  SELECT doc_id, page_index, -1 AS cluster, count(*) AS n_lines, any_value(total) AS total, min(y0) AS y0, max(y1) AS y1, 0.0 AS d, 0.0 AS m, 0.0 AS t, string_agg(text, chr(10) ORDER BY nth) AS text, -1.0 AS rated
  FROM clustered WHERE total >= 20 AND page_structured >= 0.7 AND nth BETWEEN 3 AND total - 2 GROUP BY doc_id, page_index HAVING (max(y1) - min(y0)) / 300 >= 0.2),
either AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY round(rated, 9) DESC, cluster) AS place FROM (SELECT * FROM chosen UNION ALL SELECT * FROM whole))
SELECT doc_id, page_index::INT AS page_index, n_lines, y0, y1, md5(trim(text)) AS text_md5 FROM either WHERE place = 1 AND trim(text) <> ''"""


def oracle_sql() -> dict[str, str]:
    return {
        "bm25_topk": BM25, "bm25_filtered": BM25_FILTERED, "dense_topk": DENSE, "fuse_weighted": FUSE_WEIGHTED, "fuse_rrf": FUSE_RRF, "context_expand": CONTEXT,
        "retrieval_eval": EVAL, "repeated_lines": REPEATED_LINES, "remove_repeated": REMOVE_REPEATED, "classify_lines": CLASSIFY, "noise_filter": NOISE,
        "markdown_render": MARKDOWN, "html_blocks": HTML, "token_f1_pairs": TOKEN_F1, "size_percentiles": PERCENTILES, "probe_modes": PROBE, "confusion_matrix": CONFUSION,
        "class_f1": CLASS_F1, "feature_stats": FEATURES, "plan_questions": _plan(), "route_questions": _route(), "detection_f1": DETECTION, "region_dedup": REGIONS, "run_stability": STABILITY, "ocr_tables": OCR_TABLES,
        "markdown_blocks": MARKDOWN_BLOCKS, "normal_blocks": NORMAL_BLOCKS, "region_routes": ROUTES, "extractor_choice": EXTRACTORS,
        "retrieval_cases": CASE_ROWS, "strategy_summary": STRATEGIES,
    }
