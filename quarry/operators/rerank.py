"""Second ranking of retrieved results.

A scorer takes (query, [contents]) and gives [(index, score)], or None if it failed; the overlap scorer needs no
Python. Results are those of `retrieve`, fetched deeper by `depth`.
"""

from __future__ import annotations

import json
import logging
import math
import os
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

log = logging.getLogger(__name__)

#: Most documents a provider takes at once.
CAPS = {"jina": 2048, "cohere": 100, "local": 10_000}
Scorer = Callable[[str, list[str]], "list[tuple[int, float]] | None"]


def depth(k: int, multiplier: int = 3, provider: str = "mock") -> int:
    return min(max(k * multiplier, k + 5), CAPS.get(provider, 2048))


def _reranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("base_rank"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "score", "retrieval_method")


def overlap(results: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, score_threshold: float | None = None) -> DataFrame:
    """Share of distinct query words that a chunk holds, ties in the base order; a query without words keeps its order."""
    q = queries.select("qid", F.array_distinct(text.tokens(F.col("query"))).alias("qw"))
    rows = results.join(q, "qid").join(chunks.select("id", F.array_distinct(text.tokens(F.col("content"))).alias("dw")), "id")
    share = F.when(F.size("qw") > 0, F.size(F.array_intersect("qw", "dw")) / F.size("qw")).otherwise(0.0)
    stamp = F.concat(F.lit("rerank:mock("), F.col("retrieval_method"), F.lit(")"))
    scored = rows.select("qid", "id", F.col("rank").alias("base_rank"), share.alias("score"), stamp.alias("retrieval_method"))
    return gate(_reranked(scored, k), results, k, score_threshold)


def gate(reranked: DataFrame, base: DataFrame, k: int, threshold: float | None) -> DataFrame:
    """Results under the threshold go; a query that loses all keeps its base results with their own stamp."""
    if threshold is None:
        return reranked
    kept = reranked.where(F.col("score") >= threshold)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    lost = base.where(F.col("rank") <= k).join(kept.select("qid").distinct(), "qid", "left_anti")
    return kept.select(base.columns).unionByName(lost.select(base.columns))


def cross_encoder(results: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, scorer: Scorer, provider: str, score_threshold: float | None = None) -> DataFrame:
    """Scores by any scorer, called once a query. Rows that can't be used are skipped (an index out of range or no
    index, no number); a scorer that fails or gives nothing usable leaves the base order, stamped as failed."""
    rows = results.join(queries.select("qid", "query"), "qid").join(chunks.select("id", "content"), "id")
    kinds = dict(rows.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        try:
            good = usable_scores(scorer(group["query"].iloc[0], group["content"].fillna("").tolist()), len(group))
        except Exception:
            good = []
        if not good:
            out = group.assign(base_rank=group["rank"], score=-group["rank"].astype(float), retrieval_method=[f"rerank:failed({provider},{m})" for m in group["retrieval_method"]], real=group["score"])
            return out[["qid", "id", "base_rank", "score", "real", "retrieval_method"]]
        out = group.iloc[[i for i, _ in good]].assign(score=[s for _, s in good])
        out = out.assign(base_rank=out["rank"], real=out["score"], retrieval_method=[f"rerank:{provider}({m})" for m in out["retrieval_method"]])
        return out[["qid", "id", "base_rank", "score", "real", "retrieval_method"]]

    scored = rows.groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, base_rank int, score double, real double, retrieval_method string")
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("base_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return gate(ranked.select("qid", "rank", "id", F.col("real").alias("score"), "retrieval_method"), results, k, score_threshold)


def usable_scores(scores, n: int) -> list[tuple[int, float]]:
    """(index, score) of the rows that point to one of n documents, each document once."""
    good: dict[int, float] = {}
    for row in scores or []:
        try:
            i, s = int(row[0]), float(row[1])
        except (TypeError, ValueError, IndexError):
            continue
        if 0 <= i < n and not math.isnan(s):
            good.setdefault(i, s)
    return list(good.items())


def overlap_scorer(query: str, documents: list[str]) -> list[tuple[int, float]]:
    import re

    words = set(re.findall(r"\w+", query.lower()))
    if not words:
        return [(i, 0.0) for i in range(len(documents))]
    return [(i, len(words & set(re.findall(r"\w+", d.lower()))) / len(words)) for i, d in enumerate(documents)]


class HttpScorer:
    """POST {base_url}/rerank; rows that can't be read are skipped, any failure gives None."""

    def __init__(self, base_url: str, model: str, api_key: str, timeout: float = 30.0):
        self.base_url, self.model, self.api_key, self.timeout = base_url.rstrip("/"), model, api_key, timeout

    def __call__(self, query: str, documents: list[str]):
        body = json.dumps({"model": self.model, "query": query, "documents": documents, "top_n": len(documents)}).encode()
        request = urllib.request.Request(f"{self.base_url}/rerank", body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                rows = json.load(answer).get("results", [])
        except Exception:
            return None
        out = []
        for r in rows:
            try:
                out.append((int(r["index"]), float(r["relevance_score"])))
            except (KeyError, TypeError, ValueError):
                continue
        return out


class LocalScorer:
    """Cross-encoder on the worker, loaded once each; logits through a logistic function."""

    def __init__(self, model: str):
        self.model, self._loaded = model, None

    def __getstate__(self):
        return {"model": self.model, "_loaded": None}

    def __call__(self, query: str, documents: list[str]):
        try:
            if self._loaded is None:
                from sentence_transformers import CrossEncoder

                self._loaded = CrossEncoder(self.model)
            logits = self._loaded.predict([(query, d) for d in documents])
        except Exception:
            return None
        return [(i, 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))) for i, x in enumerate(map(float, logits))]


def build_scorer(conf) -> tuple[Scorer, str] | None:
    """Scorer and provider of a `rerank` section; None without one or without its key, ValueError for another provider."""
    if not isinstance(conf, dict):
        return None
    provider = conf.get("provider", "jina")
    if provider not in ("jina", "cohere", "local", "mock"):
        raise ValueError(f"no rerank provider {provider!r}")
    if provider == "mock":
        return overlap_scorer, provider
    if provider == "local":
        return LocalScorer(conf.get("model", "BAAI/bge-reranker-v2-m3")), provider
    key = conf.get("api_key") or os.environ.get(f"{provider.upper()}_API_KEY")
    if not key:
        log.warning("rerank provider %s has no key; results are not reranked", provider)
        return None
    base = {"jina": "https://api.jina.ai/v1", "cohere": "https://api.cohere.com/v2"}[provider]
    model = {"jina": "jina-reranker-v3", "cohere": "rerank-v3.5"}[provider]
    return HttpScorer(conf.get("base_url", base), conf.get("model", model), key, conf.get("timeout", 30.0)), provider
