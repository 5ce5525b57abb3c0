"""Session helpers: the shared folder for cut lineages, and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a temporary folder is made and remembered in the session.
    """
    where = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="veinstone-")
        spark.conf.set(_SETTING, where)
    return where.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/veinstone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it any more. Files outside the engine's own folder are left alone."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/veinstone/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if own.split("://")[-1].lstrip("/") in folder:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def salted(df: DataFrame, row_key: Column, salts: int) -> DataFrame:
    """Add ``_salt`` in [0, salts) from ``row_key``, so that the rows of one hot join key spread over ``salts`` tasks."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))


#: A key counts as heavy from this share of the rows on; no more than that many keys can be heavy.
HEAVY = 1 / 256
#: Items of the sketch that looks for heavy keys: its error is below HEAVY / 4, and its size is fixed.
SKETCH = 4096


#: Bytes below which a side is one task's work, whatever its keys: nothing is gained by spreading it.
SMALL = 32 << 20


def size_of(df: DataFrame) -> int:
    """What the optimizer expects the rows to take, in bytes; for tables read it comes from the size of their files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _hash(on: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in on])


def heavy_keys(df: DataFrame, on: str | list[str], share: float = HEAVY) -> tuple[list[int], int]:
    """Hashes of the keys that hold at least ``share`` of the rows, and a number of salts that makes their parts light.

    A frequent-items sketch of fixed size looks for them: one pass over the key, combined before it reaches the driver,
    to which at most 1/share numbers come. A key of nearly that share may be among them, which does no harm.
    """
    on = [on] if isinstance(on, str) else on
    most = int(1 / share)
    keyed = df.dropna(subset=on).select(_hash(on).alias("h"))
    found = keyed.agg(F.expr(f"approx_top_k(h, {most}, {SKETCH})").alias("top"), F.count("*").alias("n")).first()
    heavy = [x for x in found["top"] or [] if x["count"] >= share * found["n"]] if found["n"] > SKETCH else []
    largest = max((x["count"] / found["n"] for x in heavy), default=0.0)
    return [x["item"] for x in heavy], max(1, min(1024, round(largest / share)))


def salted_left_join(left: DataFrame, right: DataFrame, on: str | list[str], row_key: str) -> DataFrame:
    """Left join whose left side may hold any share of its rows under one key.

    ``right`` has one row per key. Only keys that a sketch of the left side finds heavy are spread, by ``row_key``, and only
    their rows are repeated on the right; without such a key, or if the left side is small, this is a plain join. Rows whose key is null match nothing.
    """
    on = [on] if isinstance(on, str) else on
    heavy, salts = heavy_keys(left, on) if size_of(left) >= SMALL else ([], 1)
    if not heavy:
        return left.join(right, on, "left")
    hot = _hash(on).isin(heavy)
    spread = F.when(hot, F.pmod(F.xxhash64(F.col(row_key)), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    many = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.withColumn("_salt", spread).join(many, [*on, "_salt"], "left").drop("_salt")
