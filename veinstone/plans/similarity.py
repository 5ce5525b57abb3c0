"""Queries: labels, shingles, near-duplicate anchors, quote alignment, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.operators import similarity as S
from veinstone.sources.tables import table


def _anchors(spark, sf, *more):
    return table(spark, sf, "kb_anchor_registry", "id", "anchor_name", *more).distinct()


def exact_dup_groups(spark, sf):
    """Documents of equal text: class and size, one row a document."""
    d = table(spark, sf, "documents", "doc_id", "text").where("length(text) > 0").select("doc_id", F.sha1("text").alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).where("members > 1")
    return d.join(groups, "h").select("doc_id", "class_id", "members")


def label_normalise(spark, sf):
    """Labels of anchors and how many names share each."""
    return _anchors(spark, sf).groupBy(T.label(F.col("anchor_name")).alias("label")).agg(F.count("*").alias("n"))


def label_entropy(spark, sf):
    """Character entropy of labels, and whether it passes the gate of 1.2 bits."""
    l = _anchors(spark, sf).select(T.label(F.col("anchor_name")).alias("label")).distinct().where("label <> ''")
    return l.select("label", F.round(T.entropy(F.col("label")), 6).alias("entropy"), (F.round(T.entropy(F.col("label")), 6) >= 1.2).alias("passes"))


def label_shingles(spark, sf):
    """Number of shingles of each label."""
    l = _anchors(spark, sf).select(T.label(F.col("anchor_name")).alias("label")).distinct().where("label <> ''")
    return l.select("label", F.size(T.shingles(F.col("label"))).alias("shingles"))


def shingle_jaccard(spark, sf):
    """Jaccard of the shingles of each anchor's name and its first alias."""
    a = _anchors(spark, sf, "aliases").where("size(aliases) > 0").select("id", T.label(F.col("anchor_name")).alias("a"), T.label(F.col("aliases")[0]).alias("b")).where("a <> '' AND b <> ''")
    return a.select("id", F.round(T.jaccard(T.shingles(F.col("a")), T.shingles(F.col("b"))), 6).alias("jaccard"))


def fnv_hash(spark, sf):
    """FNV-1a of the section ids."""
    return table(spark, sf, "kb_section", "section_id").distinct().select("section_id", T.fnv1a(F.col("section_id")).alias("hash"))


def minhash_signatures(spark, sf):
    """The first four of the minima of seeded FNV hashes over the shingles of each label (hash of ``seed:shingle``)."""
    l = _anchors(spark, sf).select(T.label(F.col("anchor_name")).alias("label")).distinct().where("label <> ''")
    least = lambda seed: F.array_min(F.transform(T.shingles(F.col("label")), lambda x: T.fnv1a(F.concat(F.lit(f"{seed}:"), x))))
    return l.select("label", *[least(s).alias(f"m{s}") for s in range(4)])


def dedup_decisions(spark, sf):
    """Decisions on anchors of one file: labels that are equal merge; near ones are accepted from 0.94 on if they are of the same type, else pending."""
    a = _anchors(spark, sf, "file_node_id", "anchor_type").select("file_node_id", "id", "anchor_type", T.label(F.col("anchor_name")).alias("label")).where("label <> ''")
    one = a.groupBy("file_node_id", "label").agg(F.min("anchor_type").alias("type"), F.min("id").alias("id"), F.count("*").alias("members"))
    near = S.near_labels(a.select("file_node_id", "label"), ["file_node_id"])
    side = lambda x: one.select("file_node_id", F.col("label").alias(x), F.col("type").alias(f"type_{x}"), F.col("id").alias(f"id_{x}"))
    pairs = near.join(side("a"), ["file_node_id", "a"]).join(side("b"), ["file_node_id", "b"])
    same = F.coalesce(F.col("type_a") == F.col("type_b"), F.lit(False))
    fuzzy = pairs.select("file_node_id", F.least("id_a", "id_b").alias("id"), F.greatest("id_a", "id_b").alias("other"), "similarity", F.when((F.col("similarity") >= 0.94) & same, "accept").otherwise("pending").alias("decision"))
    merged = one.where("members > 1").select("file_node_id", "id", F.lit(None).cast("long").alias("other"), F.lit(1.0).alias("similarity"), F.lit("merge").alias("decision"))
    return merged.unionByName(fuzzy)


def stable_keys(spark, sf):
    """First 16 characters of the SHA-1 of each document."""
    return table(spark, sf, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.stable_key(F.col("text")).alias("key"))


def near_duplicate_anchors(spark, sf):
    """Pairs of near labels within a file, with the decision: from 0.94 accepted, else pending."""
    a = _anchors(spark, sf, "file_node_id").select("file_node_id", T.label(F.col("anchor_name")).alias("label"))
    return S.near_labels(a, ["file_node_id"]).withColumn("decision", F.when(F.col("similarity") >= 0.94, "accept").otherwise("pending"))


def dedup_winner(spark, sf):
    """Of anchors of one label and file the winner: highest confidence, plans (the primary type) first, shorter id, smaller id."""
    a = _anchors(spark, sf, "file_node_id", "confidence", "anchor_type").withColumn("label", T.label(F.col("anchor_name"))).where("label <> ''")
    order = Window.partitionBy("file_node_id", "label").orderBy(F.desc_nulls_last("confidence"), F.when(F.col("anchor_type") == "plan", 0).otherwise(1), F.length(F.col("id").cast("string")), "id")
    return a.withColumn("n", F.row_number().over(order)).where("n = 1").select("file_node_id", "label", "id")


def _quotes(spark, sf):
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "evidence_quote").distinct().where("evidence_quote IS NOT NULL AND chunk_id IS NOT NULL")
    c = table(spark, sf, "kb_chunk", "id", "latest_revision_id").select(F.col("id").alias("chunk_id"), "latest_revision_id")
    r = table(spark, sf, "kb_chunk_revision", "id", "content").select(F.col("id").alias("latest_revision_id"), "content").dropDuplicates(["latest_revision_id"])
    # Evidence is the largest side and may name one chunk very often: chunks join revisions first, then evidence, split by AQE.
    return e.join(c.join(r, "latest_revision_id"), "chunk_id")


def quote_align_exact(spark, sf):
    """Quotes that stand in the latest content of their chunk, with the offset."""
    return _quotes(spark, sf).select("id", F.expr("instr(content, evidence_quote)").alias("p")).where("p > 0").select("id", (F.col("p") - 1).alias("begin"))


def quote_align_compact(spark, sf):
    """Quotes that stand there if white space and case don't count."""
    strip = lambda c: F.lower(F.regexp_replace(c, "[ \\t\\r\\n]+", ""))
    return _quotes(spark, sf).where("instr(content, evidence_quote) = 0").where(F.contains(strip(F.col("content")), strip(F.col("evidence_quote")))).select("id")


def quote_align_all(spark, sf):
    """All quotes with state and offsets of the alignment."""
    return S.align_quotes(_quotes(spark, sf), "id", "evidence_quote", "content")


def alignment_report(spark, sf):
    """Stated alignment against the exact one."""
    q = _quotes(spark, sf).select("id", (F.expr("instr(content, evidence_quote)") > 0).alias("found"))
    stated = table(spark, sf, "kb_section_summary_evidence", "id", "alignment_status").distinct()
    return q.join(stated, "id").groupBy("alignment_status", "found").agg(F.count("*").alias("n"))


def vector_topk(spark, sf):
    """The ten vectors most similar to vector 0."""
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))
    scored = v.where("vec_id <> 0").crossJoin(q).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


def vector_topk_batch(spark, sf):
    """The five most similar vectors of every vector whose id is divisible by 50, against all."""
    v = table(spark, sf, "embeddings", "vec_id", "embedding")
    return S.search_exact(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)


def vector_label_vote(spark, sf):
    """Share of neighbours of the query's label."""
    labels = table(spark, sf, "embeddings", "vec_id", "label")
    n = vector_topk_batch(spark, sf)
    both = n.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(labels.select(F.col("vec_id").alias("id"), "label"), "id")
    return both.groupBy("query").agg(F.round(F.avg((F.col("ql") == F.col("label")).cast("double")), 6).alias("agreement"))


_L = "l AS (SELECT DISTINCT regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label FROM kb_anchor_registry WHERE anchor_name IS NOT NULL)"
_Q = """q AS (SELECT e.id, e.evidence_quote, r.content, e.alignment_status FROM (SELECT DISTINCT id, chunk_id, evidence_quote, alignment_status FROM kb_section_summary_evidence WHERE evidence_quote IS NOT NULL AND chunk_id IS NOT NULL) e
    JOIN kb_chunk c ON c.id = e.chunk_id JOIN (SELECT DISTINCT id, content FROM kb_chunk_revision) r ON r.id = c.latest_revision_id)"""
_COS = """s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id {} AND q.vec_id <> v.vec_id)"""
_SH = "list_distinct(list_transform(generate_series(1, greatest(length({0}) - k{1} + 1, 1)), lambda i: substr({0}, i, k{1})))"

_FNV = "list_reduce(list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT), lambda h, p: ((xor(h, p) * 16777619) & 4294967295)::BIGINT, 2166136261::BIGINT)"

CATALOGUE = {
    "exact_dup_groups": (exact_dup_groups, "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS members FROM documents WHERE length(text) > 0 WINDOW w AS (PARTITION BY text) QUALIFY count(*) OVER w > 1"),
    "label_normalise": (label_normalise, "SELECT regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label, count(DISTINCT id) AS n FROM kb_anchor_registry GROUP BY 1"),
    "label_entropy": (
        label_entropy,
        f"WITH {_L}, c AS (SELECT label, unnest(string_split(label, '')) AS x FROM l WHERE label <> ''), n AS (SELECT label, x, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT label, round(-sum(p * log2(p)), 6) + 0 AS entropy FROM (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM n) GROUP BY label) SELECT label, entropy, entropy >= 1.2 AS passes FROM e",
    ),
    "label_shingles": (
        label_shingles,
        f"WITH {_L}, k AS (SELECT label, CASE WHEN length(label) <= 6 THEN 2 ELSE 3 END AS k1 FROM l WHERE label <> '') SELECT label, len({_SH.format('label', 1)}) AS shingles FROM k",
    ),
    "shingle_jaccard": (
        shingle_jaccard,
        f"""WITH a AS (SELECT DISTINCT id, regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS a, regexp_replace(lower(aliases[1]), '[^0-9a-z一-鿿]', '', 'g') AS b FROM kb_anchor_registry WHERE len(aliases) > 0),
        k AS (SELECT *, CASE WHEN length(a) <= 6 THEN 2 ELSE 3 END AS k1, CASE WHEN length(b) <= 6 THEN 2 ELSE 3 END AS k2 FROM a WHERE a <> '' AND b <> ''),
        s AS (SELECT id, {_SH.format('a', 1)} AS x, {_SH.format('b', 2)} AS y FROM k) SELECT id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM s""",
    ),
    "fnv_hash": (fnv_hash, f"SELECT DISTINCT section_id, {_FNV.format('section_id')} AS hash FROM kb_section"),
    "minhash_signatures": (
        minhash_signatures,
        f"""WITH l AS (SELECT DISTINCT regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label FROM kb_anchor_registry), k AS (SELECT label, CASE WHEN length(label) <= 6 THEN 2 ELSE 3 END AS k FROM l WHERE label <> ''),
        s AS (SELECT DISTINCT label, unnest(CASE WHEN length(label) <= k THEN [label] ELSE list_transform(range(1, length(label) - k + 2), lambda i: substr(label, i, k)) END) AS x FROM k), h AS (SELECT label, seed, min({_FNV.format("seed::VARCHAR || ':' || x")}) AS m FROM s, range(4) r(seed) GROUP BY ALL)
        SELECT label, max(m) FILTER (WHERE seed = 0) AS m0, max(m) FILTER (WHERE seed = 1) AS m1, max(m) FILTER (WHERE seed = 2) AS m2, max(m) FILTER (WHERE seed = 3) AS m3 FROM h GROUP BY label""",
    ),
    "dedup_decisions": (dedup_decisions, None),
    "stable_keys": (stable_keys, "SELECT doc_id, left(sha1(text), 16) AS key FROM documents WHERE text IS NOT NULL"),
    "near_duplicate_anchors": (near_duplicate_anchors, None),
    "dedup_winner": (
        dedup_winner,
        "WITH a AS (SELECT DISTINCT id, file_node_id, confidence, anchor_type, regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label FROM kb_anchor_registry) SELECT file_node_id, label, id FROM a WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY file_node_id, label ORDER BY confidence DESC NULLS LAST, CASE WHEN anchor_type = 'plan' THEN 0 ELSE 1 END, length(id::VARCHAR), id) = 1",
    ),
    "quote_align_exact": (quote_align_exact, f"WITH {_Q} SELECT id, instr(content, evidence_quote) - 1 AS begin FROM q WHERE contains(content, evidence_quote)"),
    "quote_align_compact": (quote_align_compact, rf"WITH {_Q} SELECT id FROM q WHERE NOT contains(content, evidence_quote) AND contains(lower(regexp_replace(content, '[ \t\r\n]+', '', 'g')), lower(regexp_replace(evidence_quote, '[ \t\r\n]+', '', 'g')))"),
    "quote_align_all": (quote_align_all, None),
    "alignment_report": (alignment_report, f"WITH {_Q} SELECT alignment_status, contains(content, evidence_quote) AS found, count(*) AS n FROM q GROUP BY ALL"),
    "vector_topk": (vector_topk, f"WITH {_COS.format('= 0')} SELECT id AS vec_id, score FROM s ORDER BY score DESC, id LIMIT 10"),
    "vector_topk_batch": (vector_topk_batch, f"WITH {_COS.format('% 50 = 0')} SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s QUALIFY place <= 5"),
    "vector_label_vote": (
        vector_label_vote,
        f"WITH {_COS.format('% 50 = 0')}, t AS (SELECT query, id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5) SELECT query, round(avg((a.label = b.label)::INT), 6) AS agreement FROM t JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id GROUP BY query",
    ),
}
