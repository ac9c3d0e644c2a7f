"""Passages of texts: sentences with offsets, boundary-seeking and structure-aware chunks, rerank scores, citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

SUPPORT, UNION = 0.26, 0.62
BREAKS = ("\n\n", "\n", ". ", " ")


def sentence_spans(body: Column) -> Column:
    """array of struct(begin, end, text): trimmed sentences with their places; they end at . ! ? or a line end."""
    pieces = F.regexp_extract_all(body, F.lit(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,text:string>>").alias("out"))
    placed = F.aggregate(pieces, start, lambda a, s: F.struct((a["at"] + F.length(s)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("begin"), s.alias("text")))).alias("out")), lambda a: a["out"])
    trim = lambda p: text.let(p, lambda x: F.struct((x["begin"] + F.length(x["text"]) - F.length(F.regexp_replace(x["text"], r"^\s+", ""))).alias("begin"), F.regexp_replace(x["text"], r"^\s+|\s+$", "").alias("text")))
    out = F.transform(F.transform(placed, trim), lambda x: F.struct(x["begin"].alias("begin"), (x["begin"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))
    return F.filter(out, lambda x: x["text"] != "")


def _cut(body: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of windows that end after the last break in their second half; each begins after the one before."""
    begin = 0
    while begin < len(body):
        end = min(len(body), begin + size)
        if end < len(body):
            for sep in BREAKS:
                at = body.rfind(sep, begin + size // 2 + 1, end)
                if at >= 0:
                    end = at + len(sep)
                    break
        yield begin, end
        if end >= len(body):
            return
        begin = max(begin + 1, end - overlap)


def boundary_chunks(docs: DataFrame, key: str, body: str, size: int = 800, overlap: int = 200) -> DataFrame:
    """key, n, begin, end, text: windows of `size` letters or fewer that end at paragraphs, lines, sentences or words."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it):
        for pdf in it:
            for k, t in zip(pdf[key], pdf[body]):
                spans = list(_cut(t or "", size, overlap))
                if spans:
                    yield pd.DataFrame({key: [k] * len(spans), "n": range(len(spans)), "begin": [a for a, _ in spans], "end": [b for _, b in spans], "text": [t[a:b].strip() for a, b in spans]})

    return docs.select(key, body).mapInPandas(batches, f"{key} {kind}, n int, begin int, end int, text string")


def _blocks(body: str) -> Iterator[tuple[str, str, str]]:
    """(heading path, role, text) of a Markdown text: fenced code and tables stay whole."""
    path, held, role, fence = [], [], "text", False

    def flush():
        if t := "\n".join(held).strip():
            yield " > ".join(h for _, h in path), role, t
        held.clear()

    for line in body.split("\n"):
        if line.lstrip().startswith("```"):
            if not fence:
                yield from flush()
                role = "code"
            held.append(line)
            if fence:
                yield from flush()
                role = "text"
            fence = not fence
            continue
        head = None if fence else re.match(r"(#{1,6})\s+(.*\S)", line)
        kind = "code" if fence else "table" if line.lstrip().startswith("|") else "text"
        if head or kind != role:
            yield from flush()
            role = kind
        if head:
            level = len(head[1])
            path[:] = [(lv, h) for lv, h in path if lv < level] + [(level, head[2])]
        else:
            held.append(line)
    yield from flush()


def structure_chunks(docs: DataFrame, key: str, body: str, size: int = 450, overlap: int = 60, most: int = 8) -> DataFrame:
    """key, n, heading, role, text, numbers, dates: chunks of each heading's text; tables and code whole; of more than `most` the first and last half."""
    kind = docs.schema[key].dataType.simpleString()

    def batches(it):
        for pdf in it:
            for k, t in zip(pdf[key], pdf[body]):
                rows = []
                for heading, role, block in _blocks(t or ""):
                    parts = [block] if role != "text" else [block[a:b].strip() for a, b in _cut(block, size, overlap)]
                    rows += [(heading, role, p) for p in parts if p]
                if len(rows) > most:
                    rows = rows[: most // 2] + rows[-(most - most // 2) :]
                if rows:
                    yield pd.DataFrame({key: [k] * len(rows), "n": range(len(rows)), "heading": [r[0] for r in rows], "role": [r[1] for r in rows], "text": [r[2] for r in rows]})

    out = docs.select(key, body).mapInPandas(batches, f"{key} {kind}, n int, heading string, role string, text string")
    numbers = F.regexp_extract_all("text", F.lit(r"\b\d+(?:[.,]\d+)*\b"), F.lit(0))
    dates = F.regexp_extract_all("text", F.lit(r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(0))
    return out.withColumn("numbers", numbers).withColumn("dates", dates)


def lexical_parts(pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """pairs with overlap, bm25, phrase: share of the query's words in the text, saturated counts scaled to [0, 1], whole query in the text.

    pairs: query_id, query (words), words, body. The mean length is that of the query's own candidates.
    """
    w = Window.partitionBy("query_id")
    mean = F.greatest(F.lit(1.0), F.avg(F.size("words")).over(w))
    p = pairs.withColumn("__mean", mean)
    q = F.array_distinct("query")
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, "words")) / F.size(q)).otherwise(0.0)
    length = F.lit(k1) * (1 - b + b * F.size("words") / F.col("__mean"))
    counts = F.transform(q, lambda t: F.size(F.filter("words", lambda x: x == t)).cast("double"))
    raw = text.let(length, lambda n: F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * (k1 + 1) / (c + n)))
    phrase = F.when((F.size("query") > 0) & F.contains(F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("query", " "), F.lit(" "))), 1.0).otherwise(0.0)
    return p.withColumn("overlap", overlap).withColumn("bm25", F.least(F.lit(1.0), raw / 3)).withColumn("phrase", phrase).drop("__mean")


def passage_rerank(pairs: DataFrame, tie: str, top: int = 16, semantic: str | None = None) -> DataFrame:
    """The best passages of each query by 0.5 overlap + 0.3 bm25 + 0.2 phrase, blended 0.3 to 0.7 with a semantic score if there is one."""
    p = lexical_parts(pairs)
    score = 0.5 * F.col("overlap") + 0.3 * F.col("bm25") + 0.2 * F.col("phrase")
    p = p.withColumn("score", 0.7 * F.col(semantic) + 0.3 * score if semantic else score)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie))
    return p.withColumn("rank", rank).filter(F.col("rank") <= top)


def keyword_rerank(pairs: DataFrame, tie: str) -> DataFrame:
    """Results of each query by 0.25 overlap + 0.20 authority + 0.15 source score (of 10) + 0.20 bm25 + 0.10 phrase + 0.10 share of the query in the title.

    pairs also has authority, source_score and title_words.
    """
    p = lexical_parts(pairs)
    q = F.array_distinct("query")
    title = F.when(F.size(q) > 0, F.size(F.array_intersect(q, "title_words")) / F.size(q)).otherwise(0.0)
    score = 0.25 * F.col("overlap") + 0.20 * F.col("authority") + 0.15 * F.least(F.lit(1.0), F.col("source_score") / 10) + 0.20 * F.col("bm25") + 0.10 * F.col("phrase") + 0.10 * title
    p = p.withColumn("score", score)
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), tie)))


def support_scores(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """claim_id, doc, best (of a passage) and claim_id, union (of all cited passages): weight of a claim's words (numbers count 2 more) found.

    claims: claim_id, words; cited: claim_id, doc, n, words (passages of the documents that the claim cites).
    """
    weigh = lambda w: F.when(w.rlike("^[0-9]+$"), 3.0).otherwise(1.0)
    c = claims.select("claim_id", F.explode(F.array_distinct("words")).alias("word")).withColumn("w", weigh(F.col("word")))
    total = c.groupBy("claim_id").agg(F.sum("w").alias("total"))
    p = cited.select("claim_id", "doc", "n", F.explode(F.array_distinct("words")).alias("word"))
    hit = c.join(p, ["claim_id", "word"])
    best = hit.groupBy("claim_id", "doc", "n").agg(F.sum("w").alias("s")).groupBy("claim_id").agg(F.max(F.struct("s", (-F.col("doc")).alias("d"), (-F.col("n")).alias("k"))).alias("b"))
    union = hit.select("claim_id", "word", "w").distinct().groupBy("claim_id").agg(F.sum("w").alias("u"))
    best = best.select("claim_id", F.col("b.s").alias("s"), (-F.col("b.d")).alias("doc"), (-F.col("b.k")).alias("n"))
    out = total.join(best, "claim_id", "left").join(union, "claim_id", "left")
    return out.select("claim_id", "doc", "n", F.coalesce(F.col("s") / F.col("total"), F.lit(0.0)).alias("best"), F.coalesce(F.col("u") / F.col("total"), F.lit(0.0)).alias("union"))


def block_status(blocks: DataFrame, support: DataFrame) -> DataFrame:
    """claim_id, via, score, status of answer blocks(claim_id, kind, citations): from the best passage, else all cited passages together.

    A callout without citations speaks for the system. Not supported: partial from a score of 0.15, counting half of the union.
    """
    b = blocks.join(support, "claim_id", "left").fillna(0.0, ["best", "union"])
    cites = F.coalesce(F.col("citations"), F.lit(0)) > 0
    union = (F.col("best") > 0) & (F.col("best") < SUPPORT) & (F.col("union") >= UNION)
    via = F.when((F.col("kind") == "callout") & ~cites, "system").when(~cites, "none").when((F.col("best") >= SUPPORT) | union, "passage").when(F.col("kind") == "callout", "system").otherwise("none")
    score = F.when(via == "none", F.when(cites, F.col("best")).otherwise(0.0)).when((via == "system") & ~cites, 1.0).when(union, F.col("union")).otherwise(F.col("best"))
    status = F.when(via != "none", "SUPPORTED").when(~cites, "UNSUPPORTED").when(F.greatest(F.col("best"), 0.5 * F.col("union")) >= 0.15, "PARTIAL").otherwise("UNSUPPORTED")
    return b.select("claim_id", via.alias("via"), score.alias("score"), status.alias("status"))


def answer_metrics(status: DataFrame, answer: str) -> DataFrame:
    """answer, claims, verified_ratio, citation_precision (1 without citations), citation_coverage, unsupported."""
    ok = (F.col("status") == "SUPPORTED").cast("double")
    cited = F.coalesce(F.col("citations"), F.lit(0)) > 0
    return status.groupBy(answer).agg(F.count(F.lit(1)).alias("claims"), F.avg(ok).alias("verified_ratio"), F.coalesce(F.avg(F.when(cited, ok)), F.lit(1.0)).alias("citation_precision"), F.avg(cited.cast("double")).alias("citation_coverage"), F.count_if(F.col("status") != "SUPPORTED").alias("unsupported"))


def final_confidence(retrieval: Column, verified_ratio: Column) -> Column:
    """retrieval * (0.6 + 0.4 * verified ratio), at most 0.97, to two places."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(0.97), retrieval * (0.6 + 0.4 * verified_ratio)))
    return F.floor(x * 100 + 0.5) / 100


def document_support(support: DataFrame) -> DataFrame:
    """doc, blocks (claims that it supports, in order), best_claim, best: support(doc, claim_id, score) of supporting rows."""
    return support.groupBy("doc").agg(F.array_sort(F.collect_set("claim_id")).alias("blocks"), F.max_by("claim_id", F.struct("score", -F.col("claim_id"))).alias("best_claim"), F.max("score").alias("best"))


def quotes(claims: DataFrame, sources: DataFrame, links: DataFrame, most: int = 3, before: int = 120, after: int = 300, least: int = 3) -> DataFrame:
    """claim_id, source_id, begin, end, quote: in the first `most` sources of each claim, around its earliest word of `least` letters or more.

    claims: claim_id, words; sources: source_id, body; links: claim_id, source_id, pos. Without such a word: the source's head.
    """
    first = F.row_number().over(Window.partitionBy("claim_id").orderBy("pos", "source_id"))
    rows = links.withColumn("__i", first).filter(F.col("__i") <= most).join(claims.select("claim_id", "words"), "claim_id").join(sources.select("source_id", "body"), "source_id")
    plain = F.lower(F.translate("body", text.ACCENTED, text.PLAIN))
    at = text.let(plain, lambda b: F.array_min(F.filter(F.transform(F.filter("words", lambda w: F.length(w) >= least), lambda w: F.instr(b, w)), lambda i: i > 0)))
    rows = rows.withColumn("__at", at)
    rows = rows.withColumn("begin", F.greatest(F.lit(0), F.coalesce(F.col("__at") - 1, F.lit(0)) - before)).withColumn("end", F.least(F.length("body"), F.coalesce(F.col("__at") - 1, F.lit(0)) + after))
    return rows.select("claim_id", "source_id", "begin", "end", F.substring("body", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("quote"))


def local_rank(c: DataFrame, query: str, tie: str, radius_m: float) -> DataFrame:
    """Candidates of each query by 0.25 name overlap + 0.20 category + 0.30 specialty + 0.15 nearness (0.20 off outside) + 0.10 completeness.

    c: name_overlap (share), same_category, has_specialty (booleans), dist_m (null: unknown), filled (of 4 fields).
    """
    near = F.when(F.col("dist_m").isNull(), 0.0).when(F.col("dist_m") <= radius_m, 0.15 * (1 - F.col("dist_m") / radius_m)).otherwise(-0.20)
    score = 0.25 * F.col("name_overlap") + F.when(F.col("same_category"), 0.20).otherwise(0.0) + F.when(F.col("has_specialty"), 0.30).otherwise(0.0) + near + 0.10 * F.col("filled") / 4
    c = c.withColumn("score", score)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), tie)))


def local_quality(c: DataFrame, query: str, radius_m: float, enough: int = 5, near: int = 3) -> DataFrame:
    """query, useful, exact_category, specialty, geo_relevant, complete, candidates, sufficient.

    c: same_category, has_specialty, wants_specialty, wants_place (of the query), dist_m, complete.
    """
    geo = ~F.col("wants_place") | F.coalesce(F.col("dist_m") <= radius_m, F.lit(False))
    useful = F.col("same_category") & F.when(F.col("wants_specialty"), F.col("has_specialty")).otherwise(geo)
    g = c.groupBy(query).agg(F.count_if(useful).alias("useful"), F.count_if("same_category").alias("exact_category"), F.count_if(F.col("has_specialty") & F.col("wants_specialty")).alias("specialty"), F.count_if(geo).alias("geo_relevant"), F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("candidates"), F.max("wants_place").alias("__p"))
    return g.withColumn("sufficient", (F.col("useful") >= enough) & (~F.col("__p") | (F.col("geo_relevant") >= near))).drop("__p")
