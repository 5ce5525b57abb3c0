"""Queries on section hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.operators import hierarchy
from veinstone.sources.tables import table

_CLEAN = """
    s AS (SELECT DISTINCT section_id AS id, parent_section_id AS parent FROM kb_section WHERE section_id IS NOT NULL),
    l AS (SELECT s.id, p.id AS parent FROM s LEFT JOIN (SELECT DISTINCT id FROM s) p ON p.id = s.parent AND trim(s.parent) <> ''),
    tree AS (SELECT id, id AS root, 0 AS depth, id AS path FROM l WHERE parent IS NULL
             UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || ' > ' || l.id FROM tree t JOIN l ON l.parent = t.id),
    loose AS (SELECT id, parent FROM l WHERE id NOT IN (SELECT id FROM tree)),
    walk AS (SELECT id AS start, id AS here FROM loose UNION SELECT w.start, l.parent FROM walk w JOIN loose l ON l.id = w.here),
    ring AS (SELECT DISTINCT w.start AS id FROM walk w JOIN loose l ON l.id = w.here WHERE l.parent = w.start)
"""


def _nodes(spark: SparkSession, sf: str, paths: bool = True) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf, "kb_section", "section_id", "parent_section_id"), "section_id", "parent_section_id", paths=paths)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every section."""
    return _nodes(spark, sf, paths=False).select(F.col("id").alias("section_id"), F.col("root").alias("root_section_id"), "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path and number of sections below, of the sections that have a root."""
    return _nodes(spark, sf).where("depth >= 0").select(F.col("id").alias("section_id"), F.array_join("path", " > ").alias("full_path"), "descendants")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All sections below each section."""
    return hierarchy.descendants(_nodes(spark, sf))


def p2_circles(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of circular links, and those that run into them."""
    return _nodes(spark, sf, paths=False).where("depth < 0").select(F.col("id").alias("section_id"), "state")


def p2_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """The circles: the back edge that closes each, and its nodes from the smallest on, upwards."""
    rings = _nodes(spark, sf).where("back IS NOT NULL")
    return rings.select(F.col("id").alias("section_id"), F.col("back").alias("back_edge_to"), F.size("path").alias("length"), F.array_join("path", " > ").alias("cycle"))


CATALOGUE = {
    "p2_found": (
        p2_found,
        f"""WITH RECURSIVE {_CLEAN}
        SELECT id AS section_id, root AS root_section_id, depth FROM tree
        UNION ALL SELECT start, min(here), -1 FROM walk WHERE here IN (SELECT id FROM ring) GROUP BY start""",
    ),
    "p2_paths": (
        p2_paths,
        f"""WITH RECURSIVE {_CLEAN}, up AS (SELECT t.id, l.parent AS a FROM tree t JOIN l USING (id) WHERE l.parent IS NOT NULL
                UNION ALL SELECT u.id, l.parent FROM up u JOIN l ON l.id = u.a WHERE l.parent IS NOT NULL)
        SELECT t.id AS section_id, t.path AS full_path, count(u.id) AS descendants FROM tree t LEFT JOIN up u ON u.a = t.id GROUP BY 1, 2""",
    ),
    "p2_descendants": (
        p2_descendants,
        f"""WITH RECURSIVE {_CLEAN}, up AS (SELECT t.id, l.parent AS a, 1 AS distance FROM tree t JOIN l USING (id) WHERE l.parent IS NOT NULL
                UNION ALL SELECT u.id, l.parent, u.distance + 1 FROM up u JOIN l ON l.id = u.a WHERE l.parent IS NOT NULL)
        SELECT a AS ancestor, id, distance FROM up""",
    ),
    "p2_circles": (
        p2_circles,
        f"""WITH RECURSIVE {_CLEAN}
        SELECT id AS section_id, CASE WHEN id IN (SELECT id FROM ring) THEN 'circle' ELSE 'runs into circle' END AS state FROM loose""",
    ),
    "p2_cycles": (
        p2_cycles,
        f"""WITH RECURSIVE {_CLEAN},
        first AS (SELECT start AS id FROM walk WHERE start IN (SELECT id FROM ring) GROUP BY start HAVING start = min(here)),
        round AS (SELECT id, parent AS back, 1 AS length, id AS cycle, parent AS here FROM first JOIN l USING (id)
                  UNION ALL SELECT r.id, r.back, r.length + 1, r.cycle || ' > ' || r.here, l.parent FROM round r JOIN l ON l.id = r.here WHERE r.here <> r.id)
        SELECT id AS section_id, back AS back_edge_to, max(length) AS length, arg_max(cycle, length) AS cycle FROM round GROUP BY 1, 2""",
    ),
}
