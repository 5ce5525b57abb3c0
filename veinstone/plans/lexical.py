"""Queries: tokens, lexical routes, fusion and rescoring over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import ranking
from veinstone.sources.tables import table

QUERY = {"guarantee": 1.0, "collateral": 1.0, "branch": 1.0, "section": 0.5, "担保": 1.0, "抵押": 1.0, "bürgschaft": 1.0}
EXPANSION = {"undertaking": 1.0, "sicherheit": 1.0, "保函": 1.0}
TITLE = {"collateral": 1.0, "release": 1.0, "sicherheiten": 1.0, "early": 1.0, "repayment": 1.0, "审批": 1.0, "für": 0.5}


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", "doc_id", "text", "source")


_D = f"d AS (SELECT doc_id, text, source, {T.words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)"
_TITLE_WORDS = T.words_sql(r"regexp_extract(text, '^([^\n]*)', 1)")
_P = f"{_D}, p AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM d)"


def _values(tokens: dict[str, float]) -> str:
    return "(VALUES " + ", ".join(f"('{t}', {b}::DOUBLE)" for t, b in tokens.items()) + ") q(token, boost)"


def _l5(tokens: dict[str, float], name: str) -> str:
    return f"""{name} AS (SELECT doc_id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) / ln(1 + (n - 0.5) / 1.5)) AS score
        FROM p JOIN {_values(tokens)} USING (token) JOIN (SELECT token, count(*) AS df FROM p GROUP BY token) f USING (token), (SELECT count(*) AS n FROM d) c GROUP BY doc_id)"""


def df_stats(spark, sf):
    """In how many documents each word stands."""
    return ranking.document_frequency(_documents(spark, sf), "doc_id", F.col("text"))


def idf_query_side(spark, sf):
    """Query-side weights: log10(1 + (n - df + .5)/(df + .5)), rounded, for words of two letters or more."""
    d = _documents(spark, sf)
    n = F.broadcast(d.where("text IS NOT NULL").agg(F.count("*").alias("n")))
    stats = ranking.document_frequency(d, "doc_id", F.col("text")).where(F.length("token") >= 2)
    return stats.crossJoin(n).select("token", F.round(F.log10(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * 2.0, 3).alias("weight"))


def lexical_topk(spark, sf):
    """The 20 best documents by the binary similarity."""
    scored = ranking.binary_similarity(_documents(spark, sf), "doc_id", F.col("text"), QUERY)
    return ranking.top(scored.select("doc_id", F.round("score", 6).alias("score")), 20, F.desc("score"), F.col("doc_id"))


def bm25_topk(spark, sf):
    """The 20 best documents by BM25."""
    scored = ranking.bm25(_documents(spark, sf), "doc_id", F.col("text"), QUERY)
    return ranking.top(scored.select("doc_id", F.round("score", 6).alias("score")), 20, F.desc("score"), F.col("doc_id"))


def lexical_multifield(spark, sf):
    """Best field of each word (title line three times the text), summed over the words."""
    d = _documents(spark, sf)
    fields = [("title", T.first_line(F.col("text")), 3.0), ("text", F.col("text"), 1.0)]
    parts = None
    for name, c, boost in fields:
        p = ranking.postings(d, "doc_id", c).join(ranking.query_weights(spark, QUERY), "token").withColumn("part", F.col("boost") * boost)
        parts = p if parts is None else parts.unionByName(p)
    best = parts.groupBy("doc_id", "token").agg(F.max("part").alias("part"))
    return best.groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def lexical_expansion(spark, sf):
    """3 x the query's score and 0.75 x that of its expansion."""
    d = _documents(spark, sf)
    a = ranking.binary_similarity(d, "doc_id", F.col("text"), QUERY).withColumn("score", 3.0 * F.col("score"))
    b = ranking.binary_similarity(d, "doc_id", F.col("text"), EXPANSION).withColumn("score", 0.75 * F.col("score"))
    return a.unionByName(b).groupBy("doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def _routes(spark, sf, k: int = 50) -> DataFrame:
    d = _documents(spark, sf)
    lexical = ranking.binary_similarity(d, "doc_id", F.col("text"), QUERY).withColumn("route", F.lit("text"))
    title = ranking.binary_similarity(d.withColumn("text", T.first_line(F.col("text"))), "doc_id", F.col("text"), TITLE).withColumn("route", F.lit("title"))
    both = lexical.unionByName(title).withColumn("score", F.round("score", 6))
    return ranking.route_ranks(both, "doc_id", k)


_ROUTES = f"""{_P}, {_l5(QUERY, 's1')},
    d2 AS (SELECT doc_id, {_TITLE_WORDS} AS w FROM documents WHERE text IS NOT NULL),
    p2 AS (SELECT DISTINCT doc_id, unnest(w) AS token FROM d2),
    {_l5(TITLE, 's2').replace('FROM p JOIN', 'FROM p2 JOIN').replace('FROM p GROUP', 'FROM p2 GROUP').replace('FROM d)', 'FROM d2)')},
    both_ AS (SELECT 'text' AS route, doc_id, round(score, 6) AS score FROM s1 UNION ALL SELECT 'title', doc_id, round(score, 6) FROM s2),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY score DESC, doc_id) AS rank FROM both_) WHERE rank <= 50),
    m AS (SELECT *, min(score) OVER (PARTITION BY route) AS lo, max(score) OVER (PARTITION BY route) AS hi, CASE route WHEN 'text' THEN 0.6 ELSE 0.4 END AS w FROM r),
    u AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 / (1 + exp(-0.5 * (score - 5))) END AS unit FROM m)"""
WEIGHTS = {"text": 0.6, "title": 0.4}


def route_minmax(spark, sf):
    """Both routes on [0, 1]."""
    return ranking.min_max(_routes(spark, sf), ["route"]).select("route", "doc_id", F.round("unit", 6).alias("unit"))


def fusion_weighted_rrf(spark, sf):
    """Fusion by weighted reciprocal ranks."""
    f = ranking.fuse(_routes(spark, sf), "doc_id", WEIGHTS, "weighted_rrf", bonus=0.0)
    return f.select("doc_id", F.round("score", 8).alias("score"), "channels")


def fusion_score_aware(spark, sf):
    """Fusion by scores and ranks, with the bonus for several routes."""
    f = ranking.fuse(_routes(spark, sf), "doc_id", WEIGHTS)
    return f.select("doc_id", F.round("score", 6).alias("score"), "channels", F.round("raw", 6).alias("raw"))


def flagship_fused_search(spark, sf):
    """The 20 best documents of the fused routes."""
    f = fusion_score_aware(spark, sf)
    return ranking.top(f, 20, F.desc("score"), F.desc("channels"), F.desc("raw"), F.col("doc_id"))


_FUSED = f"{_ROUTES}, f AS (SELECT doc_id, round(sum(w * (0.65 * unit + 0.35 * 60 / (60 + rank))) + 0.005 * (count(*) - 1), 6) AS score, count(*) AS channels, round(max(score), 6) AS raw FROM u GROUP BY doc_id)"


def normalised_score(spark, sf):
    """Fused score by the highest one."""
    f = fusion_score_aware(spark, sf)
    return f.crossJoin(F.broadcast(f.agg(F.max("score").alias("most")))).select("doc_id", F.round(F.col("score") / F.col("most"), 6).alias("normalised"))


def threshold_keep_top1(spark, sf):
    """Fused documents from a normalised score of 0.9; if none reaches it the first stays."""
    f = normalised_score(spark, sf)
    first = Window.orderBy(F.desc("normalised"), "doc_id")
    best = f.orderBy(F.desc("normalised"), "doc_id").limit(1)
    passed = f.where("normalised >= 0.9")
    return passed.unionByName(best).distinct().withColumn("place", F.row_number().over(first))


def doc_match_rescore(spark, sf):
    """Documents whose source matches the scope gain 0.3, others keep 0.55 of their score; then by the highest."""
    f = fusion_score_aware(spark, sf).join(_documents(spark, sf).select("doc_id", "source"), "doc_id")
    s = f.select("doc_id", F.when(F.col("source").contains("policy"), F.col("score") + 0.3).otherwise(F.col("score") * 0.55).alias("score"))
    return s.crossJoin(F.broadcast(s.agg(F.max("score").alias("most")))).select("doc_id", F.round("score", 6).alias("score"), F.round(F.col("score") / F.col("most"), 6).alias("normalised"))


def rerank_blend(spark, sf):
    """0.45 x fused score and 0.55 x rerank score (here: title score by the highest; none is 0)."""
    f = fusion_score_aware(spark, sf)
    rr = _routes(spark, sf).where("route = 'title'").select("doc_id", F.col("score").alias("rr"))
    most = F.broadcast(rr.agg(F.max("rr").alias("most")))
    return f.join(rr, "doc_id", "left").crossJoin(most).select("doc_id", F.round(0.45 * F.col("score") + 0.55 * F.coalesce(F.col("rr") / F.col("most"), F.lit(0.0)), 6).alias("blended"))


def retry_predicate(spark, sf):
    """Whether a second pass is needed: nothing found, a top below 0.12, or no route."""
    f = fusion_score_aware(spark, sf)
    return f.agg(F.count("*").alias("found"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"), ((F.count("*") == 0) | (F.coalesce(F.max("score"), F.lit(0.0)) < 0.12) | (F.coalesce(F.max("channels"), F.lit(0)) < 1)).alias("retry"))


def candidate_merge(spark, sf):
    """Candidates of all routes merged: highest score, all routes, first non-empty text."""
    r = _routes(spark, sf).join(_documents(spark, sf).select("doc_id", "text"), "doc_id")
    return r.groupBy("doc_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"), F.substring(F.max_by("text", "score"), 1, 80).alias("head"))


def keyword_top5(spark, sf):
    """The five most frequent words (three letters or more, or runs of ideographs) of each document, by frequency and word."""
    w = _documents(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-zß-öø-ÿ]{3,}|[一-鿿]{2,})"), 1)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return w.withColumn("place", F.row_number().over(order)).where("place <= 5")


def keyword_score(spark, sf):
    """How many of the query's words each document contains as substrings."""
    kw = F.array(*[F.lit(t) for t in QUERY])
    return _documents(spark, sf).where("text IS NOT NULL").select("doc_id", F.size(F.filter(kw, lambda k: F.lower("text").contains(k))).alias("hits")).where("hits > 0")


def question_templates(spark, sf):
    """First sentence of each document as a question."""
    s = F.trim(F.regexp_extract(F.col("text"), "^([^。.!?！？\\n]*)", 1))
    return _documents(spark, sf).select("doc_id", s.alias("s")).where("length(s) > 0").select("doc_id", F.when(F.col("s").rlike("[一-鿿]"), F.concat(F.substring("s", 1, 40), F.lit("的内容是什么？"))).otherwise(F.concat(F.lit("What about: "), F.substring("s", 1, 40), F.lit("?"))).alias("question"))


def batch_search(spark, sf):
    """A query for each source (its name's words), all scored at once: the three best documents of each."""
    d = _documents(spark, sf)
    queries = d.where("source IS NOT NULL").select("source").distinct().select(F.col("source").alias("query_id"), F.explode(F.split("source", "_")).alias("token"))
    hits = ranking.postings(d, "doc_id", F.col("text")).join(F.broadcast(queries), "token")  # a few words a source
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "doc_id")
    return hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("hits")).withColumn("place", F.row_number().over(order)).where("place <= 3")


def token_shapes(spark, sf):
    """Tokens by the path they take: white space for ASCII texts, runs of ideographs and words for others."""
    d = _documents(spark, sf).where("text IS NOT NULL")
    return d.select("doc_id", F.size(T.ascii_tokens(F.col("text"))).alias("tokens"))


CATALOGUE = {
    "flagship_fused_search": (flagship_fused_search, f"WITH {_FUSED} SELECT *, row_number() OVER (ORDER BY score DESC, channels DESC, raw DESC, doc_id) AS place FROM f ORDER BY place LIMIT 20"),
    "df_stats": (df_stats, f"WITH {_P} SELECT token, count(*) AS df FROM p GROUP BY token"),
    "idf_query_side": (idf_query_side, f"WITH {_P} SELECT token, round(log10(1 + (n - df + 0.5) / (df + 0.5)) * 2.0, 3) AS weight FROM (SELECT token, count(*) AS df FROM p WHERE length(token) >= 2 GROUP BY token), (SELECT count(*) AS n FROM d)"),
    "lexical_topk": (lexical_topk, f"WITH {_P}, {_l5(QUERY, 's')} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS place FROM s ORDER BY place LIMIT 20"),
    "bm25_topk": (
        bm25_topk,
        f"""WITH {_D}, t AS (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM d), h AS (SELECT doc_id, l, token, boost, count(*) AS tf FROM t JOIN {_values(QUERY)} USING (token) GROUP BY ALL),
        f AS (SELECT token, count(*) AS df FROM h GROUP BY token), c AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
        s AS (SELECT doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))), 6) AS score FROM h JOIN f USING (token), c GROUP BY doc_id)
        SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s ORDER BY place LIMIT 20""",
    ),
    "lexical_multifield": (
        lexical_multifield,
        f"""WITH {_P}, p2 AS (SELECT DISTINCT doc_id, unnest({_TITLE_WORDS}) AS token FROM documents),
        x AS (SELECT doc_id, token, boost FROM p JOIN {_values(QUERY)} USING (token) UNION ALL SELECT doc_id, token, 3 * boost FROM p2 JOIN {_values(QUERY)} USING (token))
        SELECT doc_id, round(sum(b), 6) AS score FROM (SELECT doc_id, token, max(boost) AS b FROM x GROUP BY ALL) GROUP BY doc_id""",
    ),
    "lexical_expansion": (lexical_expansion, f"WITH {_P}, {_l5(QUERY, 'a')}, {_l5(EXPANSION, 'b')} SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 3 * score AS s FROM a UNION ALL SELECT doc_id, 0.75 * score FROM b) GROUP BY doc_id"),
    "route_minmax": (route_minmax, f"WITH {_ROUTES} SELECT route, doc_id, round(unit, 6) AS unit FROM u"),
    "fusion_weighted_rrf": (fusion_weighted_rrf, f"WITH {_ROUTES} SELECT doc_id, round(sum(w / (60 + rank)), 8) AS score, count(*) AS channels FROM u GROUP BY doc_id"),
    "fusion_score_aware": (fusion_score_aware, f"WITH {_FUSED} SELECT * FROM f"),
    "normalised_score": (normalised_score, f"WITH {_FUSED} SELECT doc_id, round(score / max(score) OVER (), 6) AS normalised FROM f"),
    "threshold_keep_top1": (
        threshold_keep_top1,
        f"WITH {_FUSED}, n AS (SELECT doc_id, round(score / max(score) OVER (), 6) AS normalised FROM f), o AS (SELECT *, row_number() OVER (ORDER BY normalised DESC, doc_id) AS place FROM n) SELECT * FROM o WHERE normalised >= 0.9 OR place = 1",
    ),
    "doc_match_rescore": (
        doc_match_rescore,
        f"WITH {_FUSED}, s AS (SELECT f.doc_id, CASE WHEN source LIKE '%policy%' THEN score + 0.3 ELSE score * 0.55 END AS s FROM f JOIN documents USING (doc_id)) SELECT doc_id, round(s, 6) AS score, round(s / max(s) OVER (), 6) AS normalised FROM s",
    ),
    "rerank_blend": (
        rerank_blend,
        f"WITH {_FUSED}, t AS (SELECT doc_id, score AS rr FROM r WHERE route = 'title') SELECT f.doc_id, round(0.45 * f.score + 0.55 * coalesce(rr / (SELECT max(rr) FROM t), 0), 6) AS blended FROM f LEFT JOIN t USING (doc_id)",
    ),
    "retry_predicate": (retry_predicate, f"WITH {_FUSED} SELECT count(*) AS found, coalesce(max(score), 0) AS top, count(*) = 0 OR coalesce(max(score), 0) < 0.12 OR coalesce(max(channels), 0) < 1 AS retry FROM f"),
    "candidate_merge": (
        candidate_merge,
        f"WITH {_ROUTES} SELECT doc_id, max(score) AS score, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, left(any_value(text), 80) AS head FROM r JOIN documents USING (doc_id) GROUP BY doc_id",
    ),
    "keyword_top5": (
        keyword_top5,
        "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zß-öø-ÿ]{3,}|[一-鿿]{2,}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM c) WHERE place <= 5",
    ),
    "keyword_score": (
        keyword_score,
        "SELECT * FROM (SELECT doc_id, " + " + ".join(f"(lower(text) LIKE '%{t}%')::INT" for t in QUERY) + " AS hits FROM documents WHERE text IS NOT NULL) WHERE hits > 0",
    ),
    "question_templates": (
        question_templates,
        "WITH s AS (SELECT doc_id, trim(regexp_extract(text, '^([^。.!?！？\\n]*)', 1)) AS s FROM documents) SELECT doc_id, CASE WHEN regexp_matches(s, '[一-鿿]') THEN left(s, 40) || '的内容是什么？' ELSE 'What about: ' || left(s, 40) || '?' END AS question FROM s WHERE length(s) > 0",
    ),
    "batch_search": (
        batch_search,
        f"WITH {_P}, q AS (SELECT DISTINCT source AS query_id FROM documents WHERE source IS NOT NULL), t AS (SELECT query_id, unnest(string_split(query_id, '_')) AS token FROM q), h AS (SELECT query_id, doc_id, count(*) AS hits FROM p JOIN t USING (token) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS place FROM h) WHERE place <= 3",
    ),
    "token_shapes": (
        token_shapes,
        r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[\x00-\x7F]*$') THEN len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '')) ELSE len(regexp_extract_all(text, '[一-鿿]{2,}|[A-Za-z0-9_]+')) END AS tokens FROM documents WHERE text IS NOT NULL",
    ),
}
