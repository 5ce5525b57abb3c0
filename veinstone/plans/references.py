"""Queries on references that do not resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators.orphans import Ledger, parents, references
from veinstone.sources.tables import table

_ORACLE = """
    refs AS (
        SELECT DISTINCT 'kb_section_summary_evidence' AS source_table, 'chunk_id' AS ref_field, id, chunk_id AS key, create_time AS time FROM kb_section_summary_evidence WHERE chunk_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'kb_section_summary_evidence', 'summary_id', id, summary_id, create_time FROM kb_section_summary_evidence WHERE summary_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'kb_anchor_registry', 'source_chunk_id', id, source_chunk_id, create_time FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL),
    targets AS (
        SELECT 'c' AS t, id, bool_and(coalesce(del_flag, false)) AS deleted, min(create_time) AS created FROM kb_chunk GROUP BY id
        UNION ALL SELECT 's', id, false, min(create_time) FROM kb_section_summary GROUP BY id),
    judged AS (
        SELECT r.*, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.deleted THEN 'deleted' WHEN p.created > r.time THEN 'late' END AS kind
        FROM refs r LEFT JOIN targets p ON p.id = r.key AND p.t = CASE WHEN r.ref_field = 'summary_id' THEN 's' ELSE 'c' END)
"""


def ledger(spark: SparkSession, sf: str, snapshots: bool = False) -> Ledger:
    """The ledger after all deliveries, taken in as three steps.

    First come chunks as they are when created, and the references made up to the middle of the time; then the
    summaries and the later references; last the deletions, which reopen what was resolved.
    """
    evidence = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "summary_id", "create_time")
    anchors = table(spark, sf, "kb_anchor_registry", "id", "source_chunk_id", "create_time")
    refs = (
        references(evidence, "kb_section_summary_evidence", "chunk_id", "kb_chunk")
        .unionByName(references(evidence, "kb_section_summary_evidence", "summary_id", "kb_section_summary"))
        .unionByName(references(anchors, "kb_anchor_registry", "source_chunk_id", "kb_chunk"))
    )
    micros = "unix_micros(cast(create_time AS timestamp))"
    middle = evidence.agg(F.expr(f"timestamp_micros((min({micros}) + max({micros})) div 2)").alias("m")).first()["m"]
    early = F.coalesce(F.col("time") <= F.lit(middle), F.lit(True)) if middle else F.lit(True)
    chunks = parents(table(spark, sf, "kb_chunk", "id", "del_flag", "create_time"), "kb_chunk", deleted="del_flag")
    summaries = parents(table(spark, sf, "kb_section_summary", "id", "create_time"), "kb_section_summary")
    first = Ledger.start(chunks.withColumn("deleted", F.lit(False)), refs.where(early), snapshots)
    second = first.step(summaries, refs.where(~early), snapshots)
    return second.step(chunks.where("deleted"), refs.where(F.lit(False)), snapshots)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference that is an orphan."""
    return ledger(spark, sf).orphans()


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans by table, field, month and kind."""
    return ledger(spark, sf).counts()


def p5_history(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshots after each of the three deliveries."""
    return ledger(spark, sf, snapshots=True).history()


CATALOGUE = {
    "p5_found": (p5_found, f"WITH {_ORACLE} SELECT source_table, ref_field, id, kind FROM judged WHERE kind IS NOT NULL"),
    "p5_counts": (
        p5_counts,
        f"WITH {_ORACLE} SELECT source_table, ref_field, strftime(time, '%Y-%m') AS period, kind, count(*) AS orphans FROM judged WHERE kind IS NOT NULL GROUP BY ALL",
    ),
    "p5_history": (
        p5_history,
        f"""WITH {_ORACLE},
        middle AS (SELECT make_timestamp((min(epoch_us(create_time)) + max(epoch_us(create_time))) // 2) AS m FROM kb_section_summary_evidence),
        steps AS (SELECT unnest([1, 2, 3]) AS step),
        seen AS (
            SELECT s.step, r.source_table, r.ref_field, r.time,
                CASE WHEN p.id IS NULL OR (p.t = 's' AND s.step < 2) THEN 'missing' WHEN p.deleted AND s.step = 3 THEN 'deleted' WHEN p.created > r.time THEN 'late' END AS kind
            FROM steps s CROSS JOIN middle JOIN refs r ON s.step >= 2 OR coalesce(r.time <= m, true)
            LEFT JOIN targets p ON p.id = r.key AND p.t = CASE WHEN r.ref_field = 'summary_id' THEN 's' ELSE 'c' END)
        SELECT step, source_table, ref_field, strftime(time, '%Y-%m') AS period, kind, count(*) AS orphans FROM seen WHERE kind IS NOT NULL GROUP BY ALL""",
    ),
}
