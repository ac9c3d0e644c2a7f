"""Queries of passages, reranking, block verification and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import passages
from .fixtures import derive, sql, table
from .registry import query
from .text_queries import d_tokens


@query("f23_sentence_passages", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') AS ps FROM documents), p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM t),
a AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
s AS (SELECT doc_id, i, start + length(p) - length(regexp_replace(p, '^\s+', '')) AS b, regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '') AS s FROM a)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, CAST(b AS INTEGER) AS begin, CAST(b + length(s) AS INTEGER) AS "end", s AS text FROM s WHERE s <> ''""")
def f23(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.posexplode(passages.sentence_spans(F.col("text"))).alias("n", "s"))
    return s.select("doc_id", "n", "s.*")


@query("f32_boundary_chunks")
def f32(spark, d):
    return passages.boundary_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("f31_structure_chunks")
def f31(spark, d):
    """Turns of a conversation under the headings of their roles."""
    t = table(spark, d, "conversations").withColumn("line", F.concat(F.lit("# "), "role", F.lit("\n"), "text"))
    t = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("body"))
    c = passages.structure_chunks(t, "conv_id", "body")
    return c.withColumn("numbers", F.size("numbers")).withColumn("dates", F.size("dates"))


#: A conversation's first turn asks; its later turns are passages.
PAIRS = """SELECT q.conv_id AS query_id, p.turn, q.text AS q, p.text AS body, CAST(p.turn * 5 % 9 AS DOUBLE) / 8 AS authority, CAST((q.conv_id + p.turn) % 15 AS DOUBLE) AS source_score
FROM {conversations} q JOIN {conversations} p ON p.conv_id = q.conv_id AND p.turn > 0 WHERE q.turn = 0"""
_LEX = f"""p AS (SELECT *, {d_tokens('q')} AS qs, {d_tokens('body')} AS ws FROM ({sql(PAIRS)})), m AS (SELECT *, list_distinct(qs) AS u, greatest(1e0, avg(len(ws)) OVER (PARTITION BY query_id)) AS mean FROM p),
x AS (SELECT *, CASE WHEN len(u) > 0 THEN len(list_intersect(u, list_distinct(ws))) / len(u)::DOUBLE ELSE 0e0 END AS overlap,
 least(1e0, coalesce(list_sum(list_transform(u, lambda t: len(list_filter(ws, lambda w: w = t)) * 2.2e0 / (len(list_filter(ws, lambda w: w = t)) + 1.2e0 * (0.25e0 + 0.75e0 * len(ws) / mean)))), 0e0) / 3) AS bm,
 CASE WHEN len(qs) > 0 AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || array_to_string(qs, ' ') || ' ') THEN 1e0 ELSE 0e0 END AS phrase,
 CASE WHEN len(u) > 0 THEN len(list_intersect(u, list_distinct(ws[1:6]))) / len(u)::DOUBLE ELSE 0e0 END AS title FROM m)"""


def pairs(spark, d):
    p = derive(spark, d, PAIRS)
    return p.select("query_id", "turn", "authority", "source_score", text.tokens(F.col("q")).alias("query"), text.tokens(F.col("body")).alias("words")).withColumn("title_words", F.slice("words", 1, 6))


@query("t7_passage_rerank", f"WITH {_LEX}, s AS (SELECT query_id, turn, 0.5e0 * overlap + 0.3e0 * bm + 0.2e0 * phrase AS score FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn) AS rank FROM s) SELECT query_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 16")
def t7(spark, d):
    return passages.passage_rerank(pairs(spark, d), "turn").select("query_id", F.round("score", 6).alias("score"), "rank")


@query("t6_keyword_rerank", f"WITH {_LEX} SELECT query_id, turn, round(0.25e0 * overlap + 0.20e0 * authority + 0.15e0 * least(1e0, source_score / 10) + 0.20e0 * bm + 0.10e0 * phrase + 0.10e0 * title, 6) AS score FROM x")
def t6(spark, d):
    return passages.keyword_rerank(pairs(spark, d), "turn").select("query_id", "turn", F.round("score", 6).alias("score"))


#: Every second turn claims something and cites the turns before it; some are callouts, some cite nothing.
CLAIMS = """SELECT conv_id, conv_id * 1000 + turn AS claim_id, turn, text, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'callout' ELSE 'paragraph' END AS kind,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 0 ELSE turn END AS citations FROM {conversations} WHERE turn > 0 AND turn % 2 = 1"""
_SUPPORT = f"""c AS ({sql(CLAIMS)}), w0 AS (SELECT DISTINCT claim_id, unnest({d_tokens('text')}) AS word FROM c), w AS (SELECT *, CASE WHEN regexp_full_match(word, '[0-9]+') THEN 3e0 ELSE 1e0 END AS w FROM w0),
p AS (SELECT DISTINCT c.claim_id, s.conv_id * 1000 + s.turn AS doc, unnest({d_tokens('s.text')}) AS word FROM c JOIN conversations s ON s.conv_id = c.conv_id AND s.turn < c.turn WHERE c.citations > 0),
h AS (SELECT claim_id, doc, word, w FROM w JOIN p USING (claim_id, word)), t AS (SELECT claim_id, sum(w) AS total FROM w GROUP BY 1), d AS (SELECT claim_id, doc, sum(w) AS s FROM h GROUP BY 1, 2),
b AS (SELECT claim_id, max(s) AS s, arg_max(doc, (s, -doc)) AS doc FROM d GROUP BY 1), u AS (SELECT claim_id, sum(w) AS u FROM (SELECT DISTINCT claim_id, word, w FROM h) GROUP BY 1),
s AS (SELECT c.claim_id, c.conv_id, c.kind, c.citations > 0 AS cites, b.doc, coalesce(b.s / total, 0e0) AS best, coalesce(u / total, 0e0) AS un FROM c LEFT JOIN t USING (claim_id) LEFT JOIN b USING (claim_id) LEFT JOIN u USING (claim_id)),
v AS (SELECT *, best > 0 AND best < 0.26e0 AND un >= 0.62e0 AS byunion, CASE WHEN kind = 'callout' AND NOT cites THEN 'system' WHEN NOT cites THEN 'none' WHEN best >= 0.26e0 OR (best > 0 AND un >= 0.62e0) THEN 'passage' WHEN kind = 'callout' THEN 'system' ELSE 'none' END AS via FROM s),
st AS (SELECT *, CASE WHEN via = 'none' THEN CASE WHEN cites THEN best ELSE 0e0 END WHEN via = 'system' AND NOT cites THEN 1e0 WHEN byunion THEN un ELSE best END AS score,
  CASE WHEN via <> 'none' THEN 'SUPPORTED' WHEN NOT cites THEN 'UNSUPPORTED' WHEN greatest(best, 0.5e0 * un) >= 0.15e0 THEN 'PARTIAL' ELSE 'UNSUPPORTED' END AS status FROM v)"""


def support(spark, d):
    c = derive(spark, d, CLAIMS)
    s = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("t"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.lit(0).alias("n"), text.tokens(F.col("text")).alias("words"))
    cited = c.filter("citations > 0").select("claim_id", "conv_id", "turn").join(s, "conv_id").filter("t < turn")
    return c, passages.support_scores(c.select("claim_id", text.tokens(F.col("text")).alias("words")), cited)


@query("t13_block_status", f"WITH {_SUPPORT} SELECT claim_id, via, round(score, 6) AS score, status FROM st")
def t13(spark, d):
    return passages.block_status(*support(spark, d)).withColumn("score", F.round("score", 6))


@query("t13_answer_metrics", f"""WITH {_SUPPORT} SELECT conv_id, count(*) AS claims, round(avg((status = 'SUPPORTED')::INT), 6) AS verified_ratio, round(coalesce(avg(CASE WHEN cites THEN (status = 'SUPPORTED')::INT END), 1e0), 6) AS citation_precision,
 round(avg(cites::INT), 6) AS citation_coverage, count(CASE WHEN status <> 'SUPPORTED' THEN 1 END) AS unsupported, floor(least(0.97e0, 0.875e0 * (0.6e0 + 0.4e0 * avg((status = 'SUPPORTED')::INT))) * 100 + 0.5e0) / 100 AS confidence FROM st GROUP BY 1""")
def t13_metrics(spark, d):
    """With the final confidence of an answer whose retrieval had 0.875."""
    c, s = support(spark, d)
    m = passages.answer_metrics(passages.block_status(c, s).join(c.select("claim_id", "conv_id", "citations"), "claim_id"), "conv_id")
    return m.select("conv_id", "claims", *[F.round(x, 6).alias(x) for x in ("verified_ratio", "citation_precision", "citation_coverage")], "unsupported", passages.final_confidence(F.lit(0.875), F.col("verified_ratio")).alias("confidence"))


@query("a37_document_support", f"WITH {_SUPPORT} SELECT doc, array_to_string(list_sort(list(DISTINCT claim_id)), ' ') AS blocks, arg_max(claim_id, (score, -claim_id)) AS best_claim, round(max(score), 6) AS best FROM st WHERE via = 'passage' GROUP BY 1")
def a37(spark, d):
    c, s = support(spark, d)
    ok = passages.block_status(c, s).filter("via = 'passage'").join(s.select("claim_id", "doc"), "claim_id")
    return passages.document_support(ok).select("doc", F.array_join(F.transform("blocks", lambda x: x.cast("string")), " ").alias("blocks"), "best_claim", F.round("best", 6).alias("best"))


_PLAIN = "lower(translate(body, '{}', '{}'))".format(text.ACCENTED, text.PLAIN)


@query("t14_quotes", f"""WITH c AS ({sql(CLAIMS)}), l AS (SELECT c.claim_id, {d_tokens('c.text')} AS ws, s.conv_id * 1000 + s.turn AS source_id, s.text AS body, row_number() OVER (PARTITION BY claim_id ORDER BY s.turn) AS i FROM c JOIN conversations s ON s.conv_id = c.conv_id AND s.turn < c.turn),
a AS (SELECT *, list_min(list_filter(list_transform(list_filter(ws, lambda w: length(w) >= 3), lambda w: instr({_PLAIN}, w)), lambda i: i > 0)) AS pl FROM l WHERE i <= 3),
b AS (SELECT *, greatest(0, coalesce(pl - 1, 0) - 120) AS x, least(length(body), coalesce(pl - 1, 0) + 300) AS y FROM a)
SELECT claim_id, source_id, CAST(x AS INTEGER) AS begin, CAST(y AS INTEGER) AS "end", substr(body, x + 1, y - x) AS quote FROM b""")
def t14(spark, d):
    c = derive(spark, d, CLAIMS)
    s = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.col("text").alias("body"))
    links = c.select("claim_id", "conv_id", "turn").join(s, "conv_id").filter("pos < turn").select("claim_id", "source_id", "pos")
    return passages.quotes(c.select("claim_id", text.tokens(F.col("text")).alias("words")), s, links)


#: Candidates of 50 local searches.
LOCAL = """SELECT c_custkey % 50 AS query_id, c_custkey AS candidate, CAST(c_custkey % 5 AS DOUBLE) / 4 AS name_overlap, c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 AS same_category, c_custkey % 7 < 3 AS has_specialty,
  c_custkey % 50 % 2 = 0 AS wants_specialty, c_custkey % 50 % 3 > 0 AS wants_place, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 6000 AS DOUBLE) END AS dist_m, c_custkey % 5 AS filled, c_custkey % 5 > 2 AS complete FROM {customer}"""
_LOCAL_SCORE = "0.25e0 * name_overlap + CASE WHEN same_category THEN 0.20e0 ELSE 0e0 END + CASE WHEN has_specialty THEN 0.30e0 ELSE 0e0 END + CASE WHEN dist_m IS NULL THEN 0e0 WHEN dist_m <= 3000 THEN 0.15e0 * (1 - dist_m / 3000) ELSE -0.20e0 END + 0.10e0 * filled / 4"


@query("t15_local_rank", f"SELECT query_id, candidate, round({_LOCAL_SCORE}, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_LOCAL_SCORE} DESC, candidate) AS INTEGER) AS rank FROM ({sql(LOCAL)})")
def t15(spark, d):
    return passages.local_rank(derive(spark, d, LOCAL), "query_id", "candidate", 3000.0).select("query_id", "candidate", F.round("score", 6).alias("score"), "rank")


@query("a35_local_quality", f"""WITH l AS (SELECT *, NOT wants_place OR coalesce(dist_m <= 3000, false) AS geo FROM ({sql(LOCAL)})), g AS (SELECT query_id, count(*) FILTER (same_category AND CASE WHEN wants_specialty THEN has_specialty ELSE geo END) AS useful,
 count(*) FILTER (same_category) AS exact_category, count(*) FILTER (has_specialty AND wants_specialty) AS specialty, count(*) FILTER (geo) AS geo_relevant, count(*) FILTER (complete) AS complete, count(*) AS candidates, bool_or(wants_place) AS p FROM l GROUP BY 1)
SELECT * EXCLUDE (p), useful >= 5 AND (NOT p OR geo_relevant >= 3) AS sufficient FROM g""")
def a35(spark, d):
    return passages.local_quality(derive(spark, d, LOCAL), "query_id", 3000.0)
