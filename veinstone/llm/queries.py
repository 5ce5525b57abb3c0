"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import lookalikes, mixing, neighbours, residue, scans, splitting, tokens
from veinstone.session import cut
from veinstone.sources.tables import table

DIM = 96


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of chunks with a cosine of 0.90 or more, one among the 10 nearest of the other."""
    vectors = table(spark, sf, "knowledge_chunks_v1", "chunk_id", "embedding_vector")
    near = neighbours.nearest(vectors, "chunk_id", "embedding_vector", DIM, k=10, least=0.9)
    return neighbours.close_pairs(near, 0.9, "chunk_id_a", "chunk_id_b")


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest others of every usable vector, whatever their cosine: (chunk_id, neighbour_id, cosine, place)."""
    vectors = table(spark, sf, "knowledge_chunks_v1", "chunk_id", "embedding_vector")
    near = neighbours.nearest(vectors, "chunk_id", "embedding_vector", DIM, k=10, trees=14, leaf=4096, adapt=1.0)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "place")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions whose content holds noise of scanned pages."""
    cases, _ = scans.find_noise(table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "content"), "id", "chunk_id", "content")
    return cases.select("id").distinct()


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Each revision's content as continuous paragraphs, with the noise put right."""
    return scans.repair(table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "content"), "id", "chunk_id", "content")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of one file and generation, and revisions of one chunk, that read the same and differ in characters."""
    anchors = table(spark, sf, "kb_anchor_registry", "id", "file_node_id", "parse_generation", "anchor_name")
    revisions = table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "content")
    model = lookalikes.train(anchors.select("anchor_name").union(revisions.select("content")))
    names = lookalikes.equal_looking(anchors, "id", "anchor_name", ["file_node_id", "parse_generation"], model)
    contents = lookalikes.equal_looking(revisions, "id", "content", ["chunk_id"], model)
    return names.select(F.lit("anchor_name").alias("field"), "*").union(contents.select(F.lit("content").alias("field"), "*"))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The one form of each anchor name and of each content, under the model of both: (field, id, form)."""
    names = table(spark, sf, "kb_anchor_registry", "id", "anchor_name").distinct()
    contents = table(spark, sf, "kb_chunk_revision", "id", "content").distinct()
    model = lookalikes.train(names.select("anchor_name").union(contents.select("content")))
    one = lambda df, c: lookalikes.one_form(df, c, model).select(F.lit(c).alias("field"), "id", "form")
    return one(names, "anchor_name").unionByName(one(contents, "content"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that must be cut."""
    return p6_pieces(spark, sf).where("piece_no = 2").select("source_table", "id")


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all revisions over 2,000 and section paths over 300 code points."""
    texts = splitting.split_texts(table(spark, sf, "kb_chunk_revision", "id", "content"), "id", "content", 2000, 100)
    paths = splitting.split_paths(table(spark, sf, "kb_section", "id", "section_path"), "id", "section_path", 300, 100)
    columns = ["id", "piece_no", "pieces", "piece"]
    return texts.select(F.lit("kb_chunk_revision").alias("source_table"), *columns).union(paths.select(F.lit("kb_section").alias("source_table"), *columns))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.encode_corpus(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def p7_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each token of each document ends, in bytes of UTF-8: what decoding a part of a document needs."""
    return tokens.encode_with_ends(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def _mix(spark: SparkSession, sf: str):
    counted = cut(tokens.count_tokens(table(spark, sf, "documents", "doc_id", "source", "text"), "text", "tokens"), "tokens")
    sources = mixing.read_sources(counted, "source", "tokens", table(spark, sf, "mix_targets"))
    mixing.plan(sources)
    return mixing.mix(counted, "doc_id", "source", "tokens", sources), sources


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used in the mix."""
    mixed, _ = _mix(spark, sf)
    return mixed.select("doc_id", "source", "tokens", "copies")


def p8_order(spark: SparkSession, sf: str) -> DataFrame:
    """The mix laid out in blocks of 100,000 tokens, each a permutation with the shares of the whole."""
    mixed, _ = _mix(spark, sf)
    return mixing.order(mixed, "doc_id", 100_000)


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.report(*_mix(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are residue, wholly or in part."""
    return residue.find_residue(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id").distinct()


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without residue, by source: how many, and how many characters."""
    kept = residue.without_residue(table(spark, sf, "documents", "doc_id", "text", "source"), "doc_id", "text")
    return kept.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_repaired, p4_found, p4_forms, p6_found, p6_pieces, p7_ids, p7_offsets, p8_mix, p8_order, p8_report, p9_found, p9_kept)}


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            SELECT DISTINCT 'kb_chunk_revision' AS source_table, id FROM kb_chunk_revision WHERE length(content) > 2000
            UNION ALL
            SELECT DISTINCT 'kb_section', id FROM kb_section WHERE length(array_to_string(list_filter(section_path, lambda x: x IS NOT NULL), ' > ')) > 300
        """,
    }
