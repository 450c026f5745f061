"""Similarity of unknown speech to characters: TF-IDF vectors as rows, cosine by join, and the decision ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, MARGIN, TOP = 0.25, 0.01, 5


def tfidf(texts: DataFrame) -> DataFrame:
    """(id, token, w): L2-normed weights of texts (id, text); tokens of two letters or more, idf = ln((1 + n) / (1 + df)) + 1."""
    tokens = texts.select("id", F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))).alias("token")).where("token is not null").groupBy("id", "token").agg(F.count("*").alias("tf"))
    n = texts.agg(F.count_distinct("id").alias("n"))  # one row
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tokens.join(df, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("x"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "token", (F.col("x") / F.col("norm")).alias("w"))


def similarities(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, gid, score): cosine of TF-IDF vectors (id, token, w) and (gid, token, w); pairs without a common token have no row."""
    c = candidates.select("gid", "token", F.col("w").alias("v"))
    return queries.join(c, "token").groupBy("id", "gid").agg(F.sum(F.col("w") * F.col("v")).alias("score"))


def decide(scores: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, top: int = TOP) -> DataFrame:
    """(id, decision, best_score, margin, reason, top) of scores (id, gid, score): the best one if it is good and clear enough, else #g?."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "gid"))
    ranked = scores.withColumn("rank", rank).where(F.col("rank") <= max(top, 2))
    out = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "gid", "score"))).alias("t"))
    best, second = F.col("t")[0], F.try_element_at("t", F.lit(2))
    gap = F.when(F.size("t") > 1, best["score"] - second["score"]).otherwise(F.lit(0.0))
    reason = F.when(F.size("t") == 1, "single").when((best["score"] >= threshold) & (gap >= margin), "threshold").otherwise("unsure")
    return out.select("id", F.when(reason != "unsure", best["gid"]).otherwise(F.lit("#g?")).alias("decision"), best["score"].alias("best_score"), gap.alias("margin"), reason.alias("reason"), F.transform(F.slice("t", 1, top), lambda x: F.struct(x["gid"].alias("gid"), x["score"].alias("score"))).alias("top"))
