"""References to records that do not exist: an incremental ledger of orphans.

The ledger is a log in the shared folder. Parents and references are kept as versions, in buckets by the hash of the key
they name, and nothing written is ever rewritten. A step takes what arrived and reads only the buckets of the keys that
arrived: new references probe the parent index, arriving parents resolve the orphans that wait for them, deletions
reopen what was resolved. It appends the new references with their state and a new version of each reference whose state
changed, so what a step writes grows with what arrived and not with the ledger. Snapshots of the counts are taken
when asked for, after any step.

Of a reference the version counts that was delivered last and, of that, judged last. So a reference that comes again with
another key is re-pointed: its old version may still be judged when its old key changes, but never counts again. Keys that many
references name are spread by the row (``session.salted_left_join``); parents are one row a key.

States: ``missing`` (no such parent), ``deleted`` (the parent is deleted), ``late`` (the parent was created after the
reference), ``resolved``. A null reference is none; one that is re-pointed to null is no longer counted. Repeated rows count once; of several
rows of one reference in one step the one with the latest time counts, of equal times the one whose key has the greatest hash, a null time being the earliest; a reference without a
time is never late; a null deletion mark counts as not deleted; of several parents of one key in one step the one
created first counts, and it is deleted only if all are. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.session import salted_left_join, shared_dir

REFERENCE = ["source_table", "ref_field", "id"]
ORPHANS = ("missing", "deleted", "late")
#: States by their number in the log.
STATES = ("none", "resolved", *ORPHANS)
#: Buckets of the keys, unless a ledger is made with more. A step that brings few keys reads few of them.
BUCKETS = 16
#: Tasks over which the rows of one bucket are spread when they are written.
SPREAD = 2

_INDEX = "target string, key long, deleted boolean, created timestamp_ntz, step int, bucket int"
_REFS = "source_table string, ref_field string, id long, target string, key long, time timestamp_ntz, state tinyint, delivered int, step int, bucket int"
_SNAPSHOT = "source_table string, ref_field string, period string, kind string, orphans long, step int"


def references(df: DataFrame, source_table: str, ref_field: str, target: str, key: str = "id", time: str = "create_time") -> DataFrame:
    """References of one field. ``target`` names the table of parents that the field refers to. Rows without an id are none."""
    rows = df.select(F.lit(source_table).alias("source_table"), F.lit(ref_field).alias("ref_field"), F.col(key).cast("long").alias("id"), F.lit(target).alias("target"), F.col(ref_field).cast("long").alias("key"), F.col(time).cast("timestamp_ntz").alias("time"))
    # Time and a hash of the key in one number: a hash aggregate does, no sort.
    order = F.coalesce(F.unix_micros(F.col("time").cast("timestamp")), F.lit(-(1 << 50))) * 2048 + F.pmod(F.xxhash64("key"), F.lit(2048))
    return rows.where("id IS NOT NULL").withColumn("o", order).groupBy(*REFERENCE, "target").agg(F.max_by("key", "o").alias("key"), F.max_by("time", "o").alias("time"))


def parents(df: DataFrame, target: str, key: str = "id", deleted: str | None = None, created: str = "create_time") -> DataFrame:
    """Parents of one table, as the ledger takes them."""
    mark = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    rows = df.select(F.lit(target).alias("target"), F.col(key).cast("long").alias("key"), mark.alias("deleted"), F.col(created).cast("timestamp_ntz").alias("created")).where("key IS NOT NULL")
    return rows.groupBy("target", "key").agg(F.min("deleted").alias("deleted"), F.min("created").alias("created"))


def _bucket(n: int):
    return F.pmod(F.xxhash64("target", "key"), F.lit(n)).cast("int")


def _state():
    number = F.when(F.col("key").isNull(), 0).when(F.col("_there").isNull(), 2).when(F.col("deleted"), 3).when(F.col("created") > F.col("time"), 4).otherwise(1)
    return number.cast("tinyint")


def judge(refs: DataFrame, index: DataFrame) -> DataFrame:
    """The references with the number of their ``state`` by the index, one row a (target, key)."""
    known = index.select("target", "key", "deleted", "created", F.lit(True).alias("_there"))
    return salted_left_join(refs, known, ["target", "key"], "id").withColumn("state", _state()).drop("deleted", "created", "_there")


def _packed():
    """What counts of a version, in one number whose greatest is the newest version: delivery, step, month of the reference, state."""
    month = F.coalesce(F.year("time") * 12 + F.month("time"), F.lit(0))
    return F.shiftleft(F.col("delivered").cast("long"), 44) + F.shiftleft(F.col("step").cast("long"), 24) + F.shiftleft(month.cast("long"), 8) + F.col("state")


@dataclass
class Ledger:
    """A ledger that stands in a folder: its index of parents, its references and its snapshots, after ``steps`` steps."""

    spark: SparkSession
    at: str
    steps: int = 0
    buckets: int = BUCKETS
    snapshots: tuple[int, ...] = ()

    @classmethod
    def empty(cls, spark: SparkSession, buckets: int = BUCKETS) -> Ledger:
        return cls(spark, f"{shared_dir(spark)}/veinstone/ledger-{uuid.uuid4().hex}", buckets=buckets)

    @classmethod
    def start(cls, new_parents: DataFrame, new_refs: DataFrame, snapshot: bool = False) -> Ledger:
        return cls.empty(new_parents.sparkSession).step(new_parents, new_refs, snapshot)

    def _read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """All versions, or those of some buckets: other buckets aren't opened."""
        if not self.steps:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.at}/{name}").where(F.col("step") <= self.steps)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _append(self, name: str, step: int, rows: DataFrame) -> None:
        """The rows of a step, in folders by bucket. A step that failed half way is written anew as a whole."""
        spread = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(F.col("id" if "id" in rows.columns else "key")), F.lit(SPREAD)))
        spread.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.at}/{name}/step={step}")

    @staticmethod
    def _newest(index: DataFrame) -> DataFrame:
        return index.groupBy("target", "key").agg(F.max_by(F.struct("deleted", "created"), "step").alias("x")).select("target", "key", "x.*")

    def step(self, new_parents: DataFrame, new_refs: DataFrame, snapshot: bool = False) -> Ledger:
        """Take in arrived or changed parents (their newest form) and new or re-pointed references, and take a snapshot if asked."""
        now = replace(self, steps=self.steps + 1)
        k = now.steps
        self._append("parents", k, new_parents.select("target", "key", "deleted", "created").withColumn("bucket", _bucket(self.buckets)))
        arrived = now._read("parents", _INDEX).where(F.col("step") == k)
        changed = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        fresh = new_refs.select(*REFERENCE, "target", "key", "time").withColumn("bucket", _bucket(self.buckets)).withColumn("delivered", F.lit(k))
        # New references probe the index as it is now.
        out = judge(fresh, self._newest(now._read("parents", _INDEX)))
        if self.steps and changed:
            # What waits for the arrived keys, or rested on them, is judged again; what comes out as before is not written.
            keys = arrived.select("target", "key", "deleted", "created", F.lit(True).alias("_there"))
            versions = self._read("refs", _REFS, changed)
            touched = salted_left_join(versions, keys, ["target", "key"], "id").where("_there")
            newest = touched.groupBy(*REFERENCE, "target", "key", "delivered", "time", "deleted", "created", "_there").agg((F.max(F.col("step") * 8 + F.col("state")) % 8).alias("was"), F.max("bucket").alias("bucket"))
            again = newest.withColumn("state", _state()).where("state <> was")
            out = out.unionByName(again.select(out.columns))
        self._append("refs", k, out)
        return now.take_snapshot() if snapshot else now

    def take_snapshot(self) -> Ledger:
        """Write the counts as they are now: a table of periods, not of references."""
        self.counts().coalesce(1).write.mode("overwrite").parquet(f"{self.at}/counts/step={self.steps}")
        return replace(self, snapshots=(*self.snapshots, self.steps))

    def latest(self) -> DataFrame:
        """(reference, state, period) of each reference in its newest version. All of it is in one number, so that a hash aggregate does."""
        rows = self._read("refs", _REFS).groupBy(*REFERENCE).agg(F.max(_packed()).alias("x"))
        month = F.shiftright("x", 8).bitwiseAND(F.lit(0xFFFF))
        period = F.when(month > 0, F.format_string("%04d-%02d", F.floor((month - 1) / 12), (month - 1) % 12 + 1))
        state = F.element_at(F.array(*[F.lit(x) for x in STATES]), (F.col("x").bitwiseAND(F.lit(0xFF)) + 1).cast("int"))
        return rows.select(*REFERENCE, state.alias("state"), period.alias("period"))

    def orphans(self) -> DataFrame:
        """(source_table, ref_field, id, kind) of all references that are orphans now."""
        return self.latest().where(F.col("state").isin(*ORPHANS)).select(*REFERENCE, F.col("state").alias("kind"))

    def counts(self) -> DataFrame:
        """Orphans by table, field, month of the reference (null is a period of its own) and kind, now."""
        return self.latest().where(F.col("state").isin(*ORPHANS)).groupBy("source_table", "ref_field", "period", F.col("state").alias("kind")).agg(F.count("*").alias("orphans"))

    def history(self) -> DataFrame:
        """The snapshots taken, each with its step."""
        if not self.snapshots:
            return self.spark.createDataFrame([], _SNAPSHOT)
        return self.spark.read.schema(_SNAPSHOT).parquet(f"{self.at}/counts").where(F.col("step").isin(*self.snapshots))
