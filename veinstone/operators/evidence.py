"""Evidence: grouping of hits, confidence, diversity, citations and incremental plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diversify(rows: list[tuple[int, str, str]], per_section: int, per_file: int, n: int) -> list[int]:
    """Ids in order of rank under two caps at once, greedily; then the deferred ones until there are n. rows: (id, section, file)."""
    taken, deferred = [], []
    sections: dict[str, int] = {}
    files: dict[str, int] = {}
    for i, s, f in rows:
        # A blank section or file never blocks: it stands for none.
        if len(taken) < n and (not s or sections.get(s, 0) < per_section) and (not f or files.get(f, 0) < per_file):
            taken.append(i)
            sections[s] = sections.get(s, 0) + 1
            files[f] = files.get(f, 0) + 1
        else:
            deferred.append(i)
    return (taken + deferred)[:n]


def cover_anchors(groups: list[tuple[int, float, set[str]]], anchors: list[str], n: int) -> list[int]:
    """For each anchor the best group that holds it and isn't taken, then the best of the rest. groups: (id, score, anchors)."""
    order = sorted(groups, key=lambda g: (-g[1], g[0]))
    taken: list[int] = []
    for a in anchors:
        found = next((g[0] for g in order if a in g[2] and g[0] not in taken), None)
        if found is not None:
            taken.append(found)
    return (taken + [g[0] for g in order if g[0] not in taken])[:n]


def capped(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """One cap: the first n of each group by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c >= 0.3, "low").otherwise("very_low")


def retrieval_confidence(best: Column, average: Column, failed: Column, no_text: Column, no_parent: Column, places: int = 4) -> Column:
    """0.6 x best + 0.4 x average, times 0.6 if the best alignment failed, 0.85 without a parent context and 0.75 without text, rounded."""
    return F.round((0.6 * best + 0.4 * average) * F.when(failed, 0.6).otherwise(1.0) * F.when(no_text, 0.75).otherwise(1.0) * F.when(no_parent, 0.85).otherwise(1.0), places)


def field_confidence(source: Column, evidence: Column, chunk: Column, consistency: Column) -> Column:
    return F.round(0.35 * source + 0.30 * evidence + 0.20 * chunk + 0.15 * consistency, 4)


def snapshot_signature(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, signature) that doesn't depend on the order of rows: hashes are added up, so no list grows with a group."""
    row = F.xxhash64(*columns)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("_a"), F.bit_xor(row).alias("_b")).select(*by, "rows", F.sha1(F.concat_ws("|", F.col("_a").cast("string"), F.col("_b").cast("string"))).alias("signature"))
