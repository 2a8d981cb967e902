"""Query rewriting before retrieval: by rule, by a chat model, or into a hypothetical answer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

ASK = {
    "llm": "Turn this question into a short search query. Keep names, numbers and terms; drop greetings and filler. Give the query alone.\n\nQuestion: {query}\n\nQuery:",
    "hyde": "Write two or three plain sentences that could stand in a document answering this question. Give the sentences alone.\n\nQuestion: {query}\n\nAnswer:",
}
LONGEST = 1000


def rewrite(queries: DataFrame, mode: str = "rule", chat: Callable[[str], str] | None = None, fallback_to_raw: bool = False) -> DataFrame:
    """Adds query_original, query_effective and rewrite_method, and sets query to the effective one.

    A chat model is asked once for each distinct query; without one, or where it fails or says nothing, the rule (or
    the query as it is) stands in.
    """
    rule = text.rewrite_rule(F.col("query"))
    own = queries.withColumn("query_original", F.col("query"))
    if mode == "rule" or chat is None:
        return own.withColumn("query_effective", rule).withColumn("rewrite_method", F.lit("rule")).withColumn("query", F.col("query_effective"))
    prompt = ASK[mode]

    @F.pandas_udf("string")
    def ask(column: pd.Series) -> pd.Series:
        out = []
        for q in column:
            try:
                out.append((chat(prompt.format(query=(q or "")[:LONGEST])) or "").strip() or None)
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    asked = queries.select("query").distinct().withColumn("_answer", ask("query"))
    joined = own.join(asked, "query", "left")
    return (
        joined.withColumn("query_effective", F.coalesce("_answer", F.col("query") if fallback_to_raw else rule))
        .withColumn("rewrite_method", F.when(F.col("_answer").isNotNull(), mode).otherwise("rule-fallback"))
        .withColumn("query", F.col("query_effective"))
        .drop("_answer")
    )
