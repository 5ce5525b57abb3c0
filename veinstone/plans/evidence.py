"""Queries: evidence groups, confidence, citations, diversity, incremental plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import evidence as E
from veinstone.sources.tables import table


def _evidence(spark, sf, *columns):
    return table(spark, sf, "kb_section_summary_evidence", "id", *columns).distinct()


def evidence_groups(spark, sf):
    """Evidence by chunk: how many, roles, alignments, first id."""
    e = _evidence(spark, sf, "kb_id", "chunk_id", "evidence_role", "alignment_status").where("chunk_id IS NOT NULL")
    return e.groupBy("kb_id", "chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.array_join(F.array_sort(F.collect_set("evidence_role")), ",").alias("roles"), F.count_if(F.col("alignment_status") == "exact").alias("exact"))


def field_conflict(spark, sf):
    """Sections whose summaries disagree on the confidence label: consistency 1, 0.75 with a majority, else 0.45."""
    s = table(spark, sf, "kb_section_summary", "section_id", "confidence").where("confidence <> ''").groupBy("section_id", "confidence").agg(F.count("*").alias("n"))
    g = s.groupBy("section_id").agg(F.count("*").alias("values"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return g.select("section_id", "values", F.when(F.col("values") == 1, 1.0).when(F.col("most") * 2 > F.col("all"), 0.75).otherwise(0.45).alias("consistency"))


def field_confidence(spark, sf):
    """Confidence of summaries from source, evidence, chunk and consistency."""
    s = table(spark, sf, "kb_section_summary", "id", "section_id", "confidence")
    e = _evidence(spark, sf, "summary_id", "chunk_id").groupBy(F.col("summary_id").alias("id")).agg(F.count("*").alias("n"), F.count("chunk_id").alias("c"))
    j = s.join(e, "id", "left").join(field_conflict(spark, sf), "section_id", "left")
    label = F.when(F.col("confidence") == "high", 0.95).when(F.col("confidence") == "medium", 0.7).when(F.col("confidence") == "low", 0.4).otherwise(0.5)
    return j.select("id", E.field_confidence(label, F.when(F.col("n") > 0, 1.0).otherwise(0.0), F.when(F.col("c") > 0, 1.0).otherwise(0.3), F.coalesce("consistency", F.lit(0.45))).alias("score"))


def retrieval_confidence(spark, sf):
    """Confidence of each section's answer from its five best groups (chunks): .6 x best + .4 x average of their scores, less if the best one's alignment failed, its section has no parent, or there is no text.

    A group's score is the length of its longest quote, up to 100 characters, as a share.
    """
    e = _evidence(spark, sf, "section_id", "chunk_id", "evidence_quote", "alignment_status").where("section_id IS NOT NULL")
    score = F.least(F.lit(100), F.coalesce(F.length("evidence_quote"), F.lit(0))) / 100
    g = e.groupBy("section_id", F.coalesce("chunk_id", F.lit(-1)).alias("chunk")).agg(F.max(score).alias("score"), F.coalesce(F.bool_and(F.coalesce("alignment_status", F.lit("failed")) == "failed"), F.lit(False)).alias("failed"), (F.count("evidence_quote") == 0).alias("empty"))
    top = g.withColumn("p", F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("score"), "chunk"))).where("p <= 5")
    first = F.col("p") == 1
    s = top.groupBy("section_id").agg(F.max("score").alias("best"), F.avg("score").alias("average"), F.max(first & F.col("failed")).alias("failed"), F.min("empty").alias("empty"))
    parents = table(spark, sf, "kb_section", "section_id", "parent_section_id").groupBy("section_id").agg(F.max("parent_section_id").alias("parent"))
    j = s.join(parents, "section_id", "left")
    c = E.retrieval_confidence(F.col("best"), F.col("average"), F.col("failed"), F.col("empty"), F.col("parent").isNull(), places=6)
    return j.select("section_id", c.alias("confidence"), E.confidence_label(c).alias("label"))


def citations_dedup(spark, sf):
    """Citations by file, chunk and the first 80 characters of the quote: the first id of each."""
    e = _evidence(spark, sf, "file_node_id", "chunk_id", "evidence_quote").where("evidence_quote IS NOT NULL")
    return e.groupBy("file_node_id", "chunk_id", F.substring("evidence_quote", 1, 80).alias("head")).agg(F.min("id").alias("id")).select("id", "file_node_id", "chunk_id")


def diversity_one_cap(spark, sf):
    """At most three pieces of evidence a section, the longest first."""
    e = _evidence(spark, sf, "section_id", "evidence_quote").where("section_id IS NOT NULL").withColumn("n", F.coalesce(F.length("evidence_quote"), F.lit(0)))
    return E.capped(e, "section_id", [F.desc("n"), F.col("id")], 3).select("section_id", "id")


def diversity_two_caps(spark, sf):
    """For each base 20 pieces of evidence under two caps at once, greedily.

    Only rows that matter go into the task of a base. Beyond the first 3 of a section, and of what is left the first 6
    of a file, nothing can be taken; of the deferred at most 20 are needed, so the first 40 of all hold enough.
    """
    e = _evidence(spark, sf, "kb_id", "section_id", "file_node_id", "evidence_quote").where("section_id IS NOT NULL").withColumn("n", F.coalesce(F.length("evidence_quote"), F.lit(0)))
    order = [F.desc("n"), F.col("id")]
    columns = ["kb_id", "id", "section_id", "file_node_id", "n"]
    first = E.capped(e, "kb_id", order, 40).select(*columns)
    open_ = E.capped(E.capped(E.capped(e, "section_id", order, 3), "file_node_id", order, 6), "kb_id", order, 20).select(*columns)
    both = first.unionByName(open_).distinct()

    def pick(pdf):
        import pandas as pd

        rows = pdf.sort_values(["n", "id"], ascending=[False, True])
        ids = E.diversify(list(zip(rows.id, rows.section_id, rows.file_node_id)), 3, 6, 20)
        return pd.DataFrame({"kb_id": pdf.kb_id.iloc[0], "id": ids, "place": range(1, len(ids) + 1)})

    return both.groupBy("kb_id").applyInPandas(pick, "kb_id long, id long, place int")


def rerank_document(spark, sf):
    """The text that a reranker gets: marked fields joined by bars, cut to 500 characters."""
    s = table(spark, sf, "kb_section_summary", "id", "file_node_id", "section_id", "section_title", "summary_type", "node_summary")
    parts = [F.concat(F.lit(f"{k}="), F.col(c)) for k, c in (("doc", "file_node_id"), ("section", "section_id"), ("title", "section_title"), ("field", "summary_type"))]
    return s.select("id", F.substring(F.concat_ws(" | ", *parts, "node_summary"), 1, 500).alias("document"))


def context_blocks(spark, sf):
    """Quotes of each section in order of their ids as one text, at most 20 a section."""
    e = _evidence(spark, sf, "section_id", "evidence_quote").where("section_id IS NOT NULL AND evidence_quote IS NOT NULL")
    top = E.capped(e, "section_id", [F.col("id")], 20)
    return top.groupBy("section_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "evidence_quote"))), lambda x: x["evidence_quote"]), "\n").alias("context"))


def snapshot_signature(spark, sf):
    """Signature of the chunks of each file, independent of their order."""
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "content_hash", "latest_revision_id")
    return E.snapshot_signature(c, ["file_node_id"], ["id", "content_hash", "latest_revision_id"])


def incremental_plan(spark, sf):
    """Whether a file's index is reused: it has rows of the present generation for all its chunks."""
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "parse_generation").select(F.col("id").alias("chunk_id"), "file_node_id", "parse_generation")
    k = table(spark, sf, "knowledge_chunks_v1", "chunk_id", "parse_generation").distinct().withColumn("there", F.lit(1))
    j = c.join(k, ["chunk_id", "parse_generation"], "left").groupBy("file_node_id").agg(F.count("*").alias("n"), F.count("there").alias("indexed"))
    return j.select("file_node_id", F.when(F.col("n") == F.col("indexed"), "reuse").otherwise("rebuild").alias("plan"))


def qa_candidates(spark, sf):
    """Question and answer pairs in documents, the first of equal questions."""
    d = table(spark, sf, "documents", "doc_id", "text")
    q = F.regexp_extract_all("text", F.lit(r"(?:^|\n)(?:Q: |Frage: |问：)([^\n]+)\n(?:A: |Antwort: |答：)"), 1)
    rows = d.where("text IS NOT NULL").select("doc_id", F.explode(q).alias("question"))
    return rows.groupBy(F.lower(F.regexp_replace("question", "[ \\t]+", "")).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


_EV = "e AS (SELECT DISTINCT id, kb_id, file_node_id, section_id, summary_id, chunk_id, evidence_quote, evidence_role, alignment_status FROM kb_section_summary_evidence)"
_CF = "cf AS (SELECT section_id, count(*) AS vals, max(n) AS most, sum(n) AS al FROM (SELECT section_id, confidence, count(*) AS n FROM kb_section_summary WHERE confidence <> '' GROUP BY ALL) GROUP BY section_id), co AS (SELECT section_id, vals, CASE WHEN vals = 1 THEN 1.0 WHEN most * 2 > al THEN 0.75 ELSE 0.45 END::DOUBLE AS consistency FROM cf)"

_EV2 = "e AS (SELECT DISTINCT id, section_id, chunk_id, evidence_quote, alignment_status FROM kb_section_summary_evidence)"

CATALOGUE = {
    "evidence_groups": (evidence_groups, f"WITH {_EV} SELECT kb_id, chunk_id, count(*) AS n, min(id) AS \"first\", coalesce(string_agg(DISTINCT evidence_role, ',' ORDER BY evidence_role), '') AS roles, count(*) FILTER (WHERE alignment_status = 'exact') AS exact FROM e WHERE chunk_id IS NOT NULL GROUP BY ALL"),
    "field_conflict": (field_conflict, f'WITH {_CF} SELECT section_id, vals AS "values", consistency FROM co'),
    "field_confidence": (
        field_confidence,
        f"""WITH {_EV}, {_CF}, n AS (SELECT summary_id, count(*) AS n, count(chunk_id) AS c FROM (SELECT DISTINCT id, summary_id, chunk_id FROM e) GROUP BY summary_id)
        SELECT s.id, round(0.35 * CASE confidence WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.5 END::DOUBLE + 0.30 * (n.n IS NOT NULL)::INT::DOUBLE + 0.20 * CASE WHEN n.c > 0 THEN 1.0 ELSE 0.3 END::DOUBLE + 0.15 * coalesce(consistency, 0.45::DOUBLE), 4) AS score FROM kb_section_summary s LEFT JOIN n ON n.summary_id = s.id LEFT JOIN co USING (section_id)""",
    ),
    "retrieval_confidence": (
        retrieval_confidence,
        f"""WITH {_EV2}, g AS (SELECT section_id, coalesce(chunk_id, -1) AS chunk, max(least(100, coalesce(length(evidence_quote), 0))) / 100 AS score, bool_and(coalesce(alignment_status, 'failed') = 'failed') AS failed, count(evidence_quote) = 0 AS empty FROM e WHERE section_id IS NOT NULL GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, chunk) AS p FROM g QUALIFY p <= 5), s AS (SELECT section_id, max(score) AS b, avg(score) AS a, bool_or(p = 1 AND failed) AS f, bool_and(empty) AS z FROM t GROUP BY section_id),
        c AS (SELECT section_id, round((0.6::DOUBLE * b + 0.4::DOUBLE * a) * CASE WHEN f THEN 0.6 ELSE 1 END::DOUBLE * CASE WHEN z THEN 0.75 ELSE 1 END::DOUBLE * CASE WHEN parent IS NULL THEN 0.85 ELSE 1 END::DOUBLE, 6) AS confidence FROM s LEFT JOIN (SELECT section_id, max(parent_section_id) AS parent FROM kb_section GROUP BY section_id) USING (section_id))
        SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END AS label FROM c""",
    ),
    "citations_dedup": (citations_dedup, f"WITH {_EV} SELECT min(id) AS id, file_node_id, chunk_id FROM e WHERE evidence_quote IS NOT NULL GROUP BY file_node_id, chunk_id, left(evidence_quote, 80)"),
    "diversity_one_cap": (diversity_one_cap, f"WITH {_EV} SELECT section_id, id FROM (SELECT DISTINCT id, section_id, evidence_quote FROM e WHERE section_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY coalesce(length(evidence_quote), 0) DESC, id) <= 3"),
    "diversity_two_caps": (
        diversity_two_caps,
        f"""WITH {_EV}, r AS (SELECT DISTINCT id, kb_id, section_id, file_node_id, coalesce(length(evidence_quote), 0) AS n FROM e WHERE section_id IS NOT NULL),
        a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY n DESC, id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY file_node_id ORDER BY n DESC, id) <= 6),
        t AS (SELECT id FROM b QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY n DESC, id) <= 20)
        SELECT kb_id, r.id, row_number() OVER (PARTITION BY kb_id ORDER BY (t.id IS NULL)::INT, n DESC, r.id)::INT AS place FROM r LEFT JOIN t ON t.id = r.id QUALIFY place <= 20""",
    ),
    "rerank_document": (rerank_document, "SELECT id, left(concat_ws(' | ', 'doc=' || file_node_id, 'section=' || section_id, 'title=' || section_title, 'field=' || summary_type, node_summary), 500) AS document FROM kb_section_summary"),
    "context_blocks": (context_blocks, f"WITH {_EV}, t AS (SELECT * FROM (SELECT DISTINCT id, section_id, evidence_quote FROM e WHERE section_id IS NOT NULL AND evidence_quote IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY id) <= 20) SELECT section_id, string_agg(evidence_quote, chr(10) ORDER BY id) AS context FROM t GROUP BY section_id"),
    "snapshot_signature": (snapshot_signature, None),
    "incremental_plan": (
        incremental_plan,
        "SELECT file_node_id, CASE WHEN count(*) = count(k.chunk_id) THEN 'reuse' ELSE 'rebuild' END AS plan FROM kb_chunk c LEFT JOIN (SELECT DISTINCT chunk_id, parse_generation FROM knowledge_chunks_v1) k ON k.chunk_id = c.id AND k.parse_generation = c.parse_generation GROUP BY file_node_id",
    ),
    "qa_candidates": (
        qa_candidates,
        r"WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\n)(?:Q: |Frage: |问：)([^\n]+)\n(?:A: |Antwort: |答：)', 1)) AS question FROM documents WHERE text IS NOT NULL) SELECT lower(regexp_replace(question, '[ \t]+', '', 'g')) AS key, min(doc_id) AS doc_id, count(*) AS n FROM q GROUP BY 1",
    ),
}
