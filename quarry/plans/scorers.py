"""Named scorers over cases and results, built by name or from a configuration."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import round3
from quarry.operators import answers, metrics, stats

log = logging.getLogger(__name__)
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def ranking(metric: str = "recall", k: int = 10) -> Scorer:
    """(qid, value) rounded; a case without needles or without results scores 0."""
    name = metrics.metric_name(metric)

    def score(cases: DataFrame, results: DataFrame) -> DataFrame:
        return metrics.per_query(cases, results, k, empty_recall=0.0).select("qid", round3(F.col(name)).alias("value"))

    return score


def citation(k: int = 0) -> Scorer:
    def score(cases: DataFrame, results: DataFrame) -> DataFrame:
        return cases.select("qid", round3(answers.citation_precision(F.col("answer"), F.col("retrieved.source"), k)).alias("value"))

    return score


def bootstrap_ci(inner: Scorer | None = None, resamples: int = 1000, seed: int = 42) -> Scorer:
    """The lower end of the interval of another scorer's values, one row."""
    inner = inner or ranking()

    def score(cases: DataFrame, results: DataFrame) -> DataFrame:
        long = inner(cases, results).withColumn("name", F.lit("inner"))
        return stats.bootstrap(long, resamples, seed=seed).select(F.lit(None).cast("long").alias("qid"), round3(F.col("ci_low")).alias("value"))

    return score


class ScorerRegistry:
    def __init__(self, defaults: bool = True):
        self._makers: dict[str, Callable[..., Scorer]] = {}
        if defaults:
            self._makers = {"retrieval_metric": ranking, "citation_precision": citation, "bootstrap_ci": bootstrap_ci}
            self._makers |= {f"retrieval_{m}": (lambda m=m, **kw: ranking(m, **kw)) for m in metrics.METRICS}

    def register(self, name: str, maker: Callable[..., Scorer]) -> None:
        self._makers[name] = maker

    def create(self, name: str, **settings) -> Scorer:
        if name not in self._makers:
            raise ValueError(f"no scorer {name!r}")
        return self._makers[name](**settings)

    def build(self, names: list[str]) -> dict[str, Scorer]:
        return {n: self.create(n) for n in names}

    def from_config(self, entries: list[dict]) -> dict[str, Scorer]:
        """Those entries that can be built."""
        out = {}
        for e in entries:
            try:
                out[e["name"]] = self.create(e["name"], **{k: v for k, v in e.items() if k != "name"})
            except Exception as error:
                log.warning("scorer %s: %s", e, error)
        return out

    def clear(self) -> None:
        self._makers.clear()
