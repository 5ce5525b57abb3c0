"""Lexical scoring, score normalisation and fusion of ranked routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions.text import words


def postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token): the distinct words of each text."""
    return df.where(text.isNotNull()).select(key, F.explode(F.array_distinct(words(text))).alias("token"))


def document_frequency(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, df). The words are distinct within a text, so a count is enough; it is combined before the shuffle."""
    return postings(df, key, text).groupBy("token").agg(F.count("*").alias("df"))


def query_weights(spark, tokens: dict[str, float]) -> DataFrame:
    """The words of one query with their boosts; a query is short."""
    return F.broadcast(spark.createDataFrame([(t, float(b)) for t, b in tokens.items()], "token string, boost double"))


def binary_similarity(df: DataFrame, key: str, text: Column, tokens: dict[str, float]) -> DataFrame:
    """(key, score): boost * ln(1 + (n - df + .5)/(df + .5)) / ln(1 + (n - .5)/1.5), summed over the words a text holds.

    Term frequency is binary and length doesn't count. Only the postings of the query's words are kept before grouping.
    """
    spark = df.sparkSession
    hits = postings(df, key, text).join(query_weights(spark, tokens), "token")
    frequency = hits.groupBy("token").agg(F.count("*").alias("df"))
    n = df.where(text.isNotNull()).agg(F.count("*").alias("n"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) / F.log(1 + (F.col("n") - 0.5) / 1.5)
    # As many rows as the query has words.
    weights = F.broadcast(frequency.crossJoin(F.broadcast(n)).select("token", idf.alias("idf")))
    return hits.join(weights, "token").groupBy(key).agg(F.sum(F.col("boost") * F.col("idf")).alias("score"))


def bm25(df: DataFrame, key: str, text: Column, tokens: dict[str, float], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) by BM25 proper, with term frequency and length."""
    spark = df.sparkSession
    all_words = df.where(text.isNotNull()).select(key, words(text).alias("w")).select(key, "w", F.size("w").alias("len"))
    stats = F.broadcast(all_words.agg(F.count("*").alias("n"), F.avg("len").alias("avg")))
    hits = all_words.select(key, "len", F.explode("w").alias("token")).join(query_weights(spark, tokens), "token").groupBy(key, "len", "token", "boost").agg(F.count("*").alias("tf"))
    frequency = F.broadcast(hits.groupBy("token").agg(F.count("*").alias("df")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return hits.join(frequency, "token").crossJoin(stats).groupBy(key).agg(F.sum(F.col("boost") * idf * tf).alias("score"))


def min_max(df: DataFrame, by: list[str], score: str = "score", out: str = "unit") -> DataFrame:
    """Scores on [0, 1] within each group; where all are equal, a logistic of the score."""
    ends = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    flat = 1 / (1 + F.exp(-0.5 * (F.col(score) - 5)))
    unit = F.when(F.col("_hi") > F.col("_lo"), (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(flat)
    return df.join(F.broadcast(ends), by).withColumn(out, unit).drop("_lo", "_hi") if by else df.crossJoin(F.broadcast(ends)).withColumn(out, unit).drop("_lo", "_hi")


def route_ranks(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each route with their rank: (route, key, score, rank). Spark cuts each partition to k before the sort."""
    order = Window.partitionBy("route").orderBy(F.desc("score"), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(routes: DataFrame, key: str, weights: dict[str, float], mode: str = "score_aware", k: int = 60, bonus: float = 0.005, score_share: float = 0.65) -> DataFrame:
    """(key, score, channels, raw): contributions of all routes, and a bonus for each route more.

    ``weighted_rrf``: w/(k + rank). ``score_aware``: w * (share * unit score + (1 - share) * k/(k + rank)). Of an item that a
    route holds twice, the first place counts.
    """
    once = routes.groupBy("route", key).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("route")]
    if mode == "weighted_rrf":
        part = weight / (k + F.col("rank"))
    else:
        once = min_max(once, ["route"])
        part = weight * (score_share * F.col("unit") + (1 - score_share) * k / (k + F.col("rank")))
    channels = F.count("*")
    return once.withColumn("part", part).groupBy(key).agg((F.sum("part") + bonus * (channels - 1)).alias("score"), channels.alias("channels"), F.max("score").alias("raw"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by a total order, with their place."""
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))
