"""Ranking metrics over results joined with golden needles.

A result is relevant if any needle is, letter case aside, part of its content. cases(qid, gold_needles); results(qid,
rank, content). Every case has a row in the outcome, whether or not anything was retrieved for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clamp, round3

METRICS = ("recall", "precision", "hit", "mrr", "ndcg")
ALIASES = {"hit_rate": "hit"}


def metric_name(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in METRICS:
        raise ValueError(f"no metric {name!r}; there are {', '.join(METRICS)}")
    return name


def per_query(cases: DataFrame, results: DataFrame, k: int, empty_recall: float = 1.0) -> DataFrame:
    """(qid, recall, precision, hit, mrr, ndcg) at k, unrounded.

    recall: distinct needles covered by all needles, empty_recall without needles (1 in a run, 0 in a scorer);
    precision: relevant results by k; mrr: 1 by the first relevant rank; ndcg: against the best order of what was
    retrieved. The needle test is a theta join of each query's own rows, at most k results by its needles.
    """
    needles = F.filter(F.coalesce("gold_needles", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    own = cases.select("qid", needles.alias("needles"))
    ranked = results.select("qid", "rank", F.lower(F.coalesce("content", F.lit(""))).alias("content"))
    rows = own.join(ranked, "qid", "left")
    hits = F.filter("needles", lambda x: F.contains(F.col("content"), F.lower(x)))
    rows = rows.withColumn("covered", F.when(F.col("content").isNotNull(), hits).otherwise(F.array().cast("array<string>")))
    relevant = F.size("covered") > 0
    inside = F.coalesce(F.col("rank") <= k, F.lit(False))
    one = F.when(relevant & inside, 1.0).otherwise(0.0)
    per = rows.groupBy("qid").agg(
        F.first("needles").alias("needles"),
        F.array_distinct(F.flatten(F.collect_list(F.when(inside, F.col("covered"))))).alias("covered"),
        F.sum(one).alias("relevant"),
        F.min(F.when(relevant & inside, F.col("rank"))).alias("first"),
        F.sum(one / F.log2(F.coalesce("rank", F.lit(1)) + 1)).alias("dcg"),
        F.sum(F.when(relevant, 1).otherwise(0)).alias("all_relevant"),
    )
    some = F.size("needles") > 0
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("all_relevant", F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select(
        "qid",
        clamp(F.when(~some, F.lit(empty_recall)).otherwise(F.size("covered") / F.size("needles"))).alias("recall"),
        clamp(F.when(some & (F.lit(k) > 0), F.col("relevant") / F.lit(max(k, 1))).otherwise(0.0)).alias("precision"),
        F.when(some & (F.col("relevant") > 0), 1.0).otherwise(0.0).alias("hit"),
        F.when(some & F.col("first").isNotNull(), 1.0 / F.col("first")).otherwise(0.0).alias("mrr"),
        clamp(F.when(some & (F.col("all_relevant") > 0), F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg"),
    )


def long_form(scores: DataFrame, names=METRICS) -> DataFrame:
    """(qid, name, value)"""
    return scores.unpivot("qid", list(names), "name", "value")


def means(scores: DataFrame, names=METRICS) -> DataFrame:
    return long_form(scores, names).groupBy("name").agg(round3(F.avg("value")).alias("mean"), F.count("*").alias("n"))
