"""Relations between chunks of one file and generation, by rules over what is known of each chunk.

Rules of equality tie all chunks of one key to each other. All pairs of a group would grow with its square, so a
group is a class: one row a chunk with the class, its members and the number of links. Rules between two roles give each chunk
the number of links to the other role. Rules of order and of context give edges.

A chunk has (id, file, generation, seq, section_type, meta), meta being a map of strings; parties are joined by ``|``.
Null and empty keys tie nothing; a row delivered twice counts once; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import salted_left_join

# Rules of equality with their weights.
EQUAL = {
    "same_section_type": 0.6, "same_group": 0.85, "same_business_block": 0.78, "same_clause": 0.9, "same_chapter": 0.7, "same_table": 0.8, "same_title_parent": 0.65,
    "same_module": 0.72, "same_api": 0.9, "db_schema_related": 0.88, "config_related": 0.78, "related_obligation": 0.74, "same_party": 0.68,
}
# Rules between two roles with their weights.
ROLES = {"parent_clause": 0.95, "api_param": 0.86, "api_example": 0.8, "api_error_code": 0.84, "payment_breach_related": 0.75, "term_breach_related": 0.72}
# Rules of order and of context with their weights.
EDGES = {"adjacent_next": 1.0, "adjacent_clause": 0.82, "section_context": 0.92, "parent_context": 0.74}

GROUP = ["file", "generation"]


def _m(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col("meta")[n], F.lit("")) for n in names])


def memberships() -> list[tuple[str, Column, Column]]:
    """(rule, key, role) of each rule: a chunk whose key is null has no part in it. Of two roles the first is ``a``."""
    kind, api = F.col("section_type"), _m("api_key", "api_group_id")
    one, a, b = F.lit(""), F.lit("a"), F.lit("b")
    among = lambda *types: kind.isin(*types)
    out = [
        ("same_section_type", F.when(kind != "other", F.nullif(kind, F.lit(""))), one), ("same_group", _m("chunk_group_id"), one), ("same_business_block", _m("business_block_id"), one),
        ("same_clause", _m("clause_id"), one), ("same_chapter", _m("chapter_id"), one), ("same_table", _m("table_key"), one), ("same_title_parent", _m("title_parent"), one),
        ("same_module", _m("module_key", "module"), one), ("same_api", api, one), ("db_schema_related", _m("table_key", "table_name"), one),
        ("config_related", F.when(kind == "config_item", F.coalesce(_m("module"), F.lit("-"))), one), ("related_obligation", _m("obligation_subject_key", "obligation_subject"), one),
        ("parent_clause", _m("clause_id"), a), ("parent_clause", _m("parent_clause_id"), b),
        ("payment_breach_related", F.when(among("payment_term"), F.lit("-")), a), ("payment_breach_related", F.when(among("breach_clause"), F.lit("-")), b),
        ("term_breach_related", F.when(among("term_effective", "delivery_acceptance", "payment_term"), F.lit("-")), a), ("term_breach_related", F.when(among("breach_clause"), F.lit("-")), b),
    ]
    for other in ("api_param", "api_example", "api_error_code"):
        out += [(other, F.when(among("api_spec"), api), a), (other, F.when(among(other), api), b)]
    return out


def classes(chunks: DataFrame) -> DataFrame:
    """(rule, id, role, class_id, members, links, weight): class_id is the smallest chunk of the class, or of the other role; links leads to others only."""
    weight = F.create_map(*[F.lit(x) for pair in (EQUAL | ROLES).items() for x in pair])
    own = [F.struct(F.lit(rule).alias("rule"), key.alias("key"), role.alias("role")) for rule, key, role in memberships()]
    parties = F.transform(F.filter(F.array_distinct(F.split(F.coalesce(F.col("meta")["parties"], F.lit("")), r"\|")), lambda x: x != ""), lambda x: F.struct(F.lit("same_party").alias("rule"), x.alias("key"), F.lit("").alias("role")))
    all_ = F.concat(F.filter(F.array(*own), lambda x: x["key"].isNotNull()), parties)
    rows = chunks.dropDuplicates(["id"]).select("id", *GROUP, F.explode(all_).alias("x")).select("id", *GROUP, "x.*")
    # Counts are combined before the shuffle; a class comes back to its members by a join that may be as uneven as it likes.
    sizes = rows.groupBy(*GROUP, "rule", "key").agg(
        F.count_if(F.col("role") == "a").alias("a"), F.count_if(F.col("role") == "b").alias("b"), F.count("*").alias("n"), F.min("id").alias("least"),
        F.min(F.when(F.col("role") == "a", F.col("id"))).alias("first_a"), F.min(F.when(F.col("role") == "b", F.col("id"))).alias("first_b"),
    )
    joined = salted_left_join(rows, sizes, [*GROUP, "rule", "key"], "id")
    equal = F.col("role") == ""
    links = F.when(equal, F.col("n") - 1).when(F.col("role") == "a", F.col("b")).otherwise(F.col("a"))
    first = F.when(equal, F.col("least")).when(F.col("role") == "a", F.col("first_b")).otherwise(F.col("first_a"))
    return joined.select("rule", "id", "role", first.alias("class_id"), F.col("n").alias("members"), links.alias("links"), weight[F.col("rule")].alias("weight")).where("links > 0")


def successors(df: DataFrame, by: list[str], order: str, key: str, width: int = 1000) -> DataFrame:
    """df with ``next``: the key of the row after each in its group, by (order, key). A group of any size is cut at multiples of ``width`` of the order."""
    cell = df.withColumn("_cell", F.floor(F.coalesce(F.col(order), F.lit(-1)) / width))
    inside = cell.withColumn("_next", F.lead(key).over(Window.partitionBy(*by, "_cell").orderBy(order, key)))
    firsts = cell.groupBy(*by, "_cell").agg(F.min(F.struct(F.coalesce(F.col(order), F.lit(-1)), key))[key].alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*by).orderBy("_cell"))).drop("_first")  # one row a cell
    joined = inside.join(after, [*by, "_cell"], "left")
    return joined.withColumn("next", F.coalesce("_next", "_after")).drop("_cell", "_next", "_after")


def edges(chunks: DataFrame, children: DataFrame) -> DataFrame:
    """(rule, from_id, to_id, weight): the next chunk, the next clause, and from each child to its section or parent chunk.

    children: (context, kind, child), kind being section_chunk or parent_chunk.
    """
    c = chunks.dropDuplicates(["id"]).withColumn("clause", F.expr("try_cast(meta['clause_order'] AS int)"))
    n = successors(c, GROUP, "seq", "id").where("next IS NOT NULL").select("id", "next", "clause")
    clause_of = c.select(F.col("id").alias("next"), F.col("clause").alias("next_clause"))
    pairs = n.join(clause_of, "next")
    by_clause = pairs.where("clause + 1 = next_clause")
    context = children.select(F.when(F.col("kind") == "section_chunk", "section_context").otherwise("parent_context").alias("rule"), F.col("child").alias("from_id"), F.col("context").alias("to_id")).distinct()
    weight = F.create_map(*[F.lit(x) for pair in EDGES.items() for x in pair])
    all_ = (
        pairs.select(F.lit("adjacent_next").alias("rule"), F.col("id").alias("from_id"), F.col("next").alias("to_id"))
        .unionByName(by_clause.select(F.lit("adjacent_clause").alias("rule"), F.col("id").alias("from_id"), F.col("next").alias("to_id"))).unionByName(context)
    )
    return all_.withColumn("weight", weight[F.col("rule")])
