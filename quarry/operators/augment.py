"""Context for an answer from ranked results: relevance gate, one of each content, numbered citations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Formats that readers of the context rely on.
EMPTY = (
    "[RETRIEVAL_EMPTY] No relevant context was retrieved for this query. Do not fabricate, infer, or speculate from "
    "parametric knowledge. If you cannot answer from prior conversation, state that you do not have enough information."
)
NO_CONTEXT = "(no context retrieved)"


def gated(results: DataFrame, relevance_threshold: float | None) -> DataFrame:
    return results if relevance_threshold is None else results.where(F.col("score") >= relevance_threshold)


def one_of_each(results: DataFrame) -> DataFrame:
    """The best-ranked result of each content of a query, numbered anew from 1."""
    first = Window.partitionBy("qid", F.sha2("content", 256)).orderBy("rank")
    kept = results.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def _joined(results: DataFrame, separator: str) -> DataFrame:
    """One context for each query. A query has at most its k results, so the list is bounded."""
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] [Source: "), F.coalesce("source", F.col("doc_id").cast("string")), F.lit("]\n"), F.coalesce("content", F.lit("")))
    rows = results.select("qid", F.struct("position", block.alias("text")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), separator).alias("context"))


def cited_context(queries: DataFrame, results: DataFrame, relevance_threshold: float | None = None, separator: str = "\n---\n", empty: str | None = EMPTY) -> DataFrame:
    """(qid, context) for every query; those without results get the marker."""
    context = _joined(one_of_each(gated(results, relevance_threshold)), separator)
    return queries.select("qid").distinct().join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit(empty)))


def evaluation_context(queries: DataFrame, results: DataFrame) -> DataFrame:
    numbered = results.withColumn("position", F.col("rank"))
    return queries.select("qid").distinct().join(_joined(numbered, "\n\n"), "qid", "left").withColumn("context", F.coalesce("context", F.lit(NO_CONTEXT)))


def message(context, user):
    return F.concat(F.lit("Document context:\n---\n"), context, F.lit("\n---\n\nQuestion: "), user)


def in_memory(queries: DataFrame, results: DataFrame, relevance_threshold: float | None = None) -> DataFrame:
    """(qid, message): the query in its context; a query without results stays as it is."""
    context = cited_context(queries, results, relevance_threshold, empty=None)
    return queries.join(context, "qid").select("qid", F.when(F.col("context").isNull(), F.col("query")).otherwise(message(F.col("context"), F.col("query"))).alias("message"))


def last_user_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, query) of the last turn of the user; conversations without one have no row."""
    own = conversations.where(F.col("role") == "user")
    return own.groupBy("conv_id").agg(F.max_by(F.struct("turn", F.col("text").alias("query")), "turn").alias("x")).select("conv_id", "x.*")


def on_the_fly(conversations: DataFrame, contexts: DataFrame) -> DataFrame:
    """The conversations with their last user turn put into its context(conv_id, context)."""
    last = last_user_turns(conversations).select("conv_id", "turn").join(contexts, "conv_id")
    rows = conversations.join(last, ["conv_id", "turn"], "left")
    changed = (F.col("role") == "user") & F.col("context").isNotNull()
    return rows.withColumn("text", F.when(changed, message(F.col("context"), F.col("text"))).otherwise(F.col("text"))).drop("context")


def _three_digits(x: pd.Series) -> pd.Series:
    """The double itself rounded, as printf does; the JVM's formatter rounds its shortest decimal form."""
    return x.map(lambda v: f"{v:.3f}")


def markdown(results: DataFrame, with_method: bool = True) -> DataFrame:
    """(qid, text): results as numbered blocks for a reader or a tool's answer."""
    head = F.format_string("[%d] [Source: %s] (score: %s" + (", method: %s)" if with_method else ")"), F.col("rank"), F.coalesce("source", F.col("doc_id").cast("string")), F.pandas_udf(_three_digits, "string")("score"), *([F.col("retrieval_method")] if with_method else []))
    rows = results.select("qid", F.struct("rank", F.concat(head, F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text")).alias("x"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n\n---\n\n").alias("text"))
