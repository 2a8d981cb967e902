"""From a flat configuration to a composed retrieval, and its evaluation."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.models import with_vectors
from quarry.functions.runtime import cut
from quarry.operators import answers as answer_scores
from quarry.operators import augment, metrics, rerank, rewrite, stats
from quarry.operators.index import Corpus
from quarry.plans import registry
from quarry.plans.stores import Store
from quarry.sources import files


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        conf = yaml.safe_load(f)
    if not isinstance(conf, dict):
        raise ConfigError(f"{path} holds no mapping")
    return dict(conf)


def build_chunks(spark: SparkSession, conf: dict, embedder: Callable | None = None) -> DataFrame:
    """chunks(id, doc_id, content, chunk_index, source, source_format) of the configured documents."""
    docs = files.documents(spark, conf.get("documents") or [], conf.get("max_document_size_mb", 10), conf.get("document_cache_path"), registry.parser.components())
    name = conf.get("chunker", "paragraph")
    name = name if name in registry.chunker.names() else "paragraph"
    chunks = registry.chunker.get(name)(docs, **registry.chunker.settings(name, conf, embedder=embedder))
    about = docs.select("doc_id", "source_format").dropDuplicates(["doc_id"])
    return chunks.join(about, "doc_id").withColumn("source", F.col("doc_id"))


@dataclass
class Pipeline:
    """Rewriting, retrieval, then reranking by the query as it was asked."""

    conf: dict
    corpus: Corpus
    embedder: Callable | None = None
    chat: Callable[[str], str] | None = None
    store: Store | None = None
    scorer: tuple | None = field(default=None)

    def retrieve(self, queries: DataFrame, k: int | None = None, where: dict | None = None) -> DataFrame:
        """results(qid, rank, id, score, retrieval_method, doc_id, content, source) of queries(qid, query)."""
        k = k or int(self.conf.get("top_k", 5))
        asked = queries
        if self.conf.get("hyde") or self.conf.get("query_rewrite"):
            raw = bool((self.conf.get("rewrite") or {}).get("fallback_to_raw", False))
            asked = rewrite.rewrite(queries, "hyde" if self.conf.get("hyde") else "llm", self.chat, raw)
        section = self.conf.get("rerank") if self.scorer else None
        provider = self.scorer[1] if self.scorer else ""
        fetch = rerank.depth(k, section.get("fetch_multiplier", 3), provider) if section else k
        base = self._base(asked, fetch, where)
        if section:
            gate = section.get("score_threshold")
            run = (lambda: rerank.overlap(base, queries, self.corpus.chunks, k, gate)) if provider == "mock" else (lambda: rerank.cross_encoder(base, queries, self.corpus.chunks, k, self.scorer[0], provider, gate))
            base = run()
        kept = [c for c in ("id", "doc_id", "content", "source") if c in self.corpus.chunks.columns]
        return base.join(self.corpus.chunks.select(kept), "id")

    def augmented(self, queries: DataFrame, k: int | None = None, where: dict | None = None) -> DataFrame:
        """(qid, message) by the configured augmentation, in_memory if none is."""
        name = registry.augmentation.get(self.conf.get("augmentation", "in_memory"), "in_memory")
        return name(queries, self.retrieve(queries, k, where), self.conf.get("relevance_threshold"))

    def close(self) -> None:
        """Lets go of what the pipeline holds in the executors' memory."""
        self.corpus.chunks.unpersist()

    def _base(self, queries: DataFrame, k: int, where: dict | None) -> DataFrame:
        name = self.conf.get("retriever", "keyword")
        if self.store is not None:
            return self.store.search(queries, k, where)
        name = name if name in registry.retriever.names() else "keyword"
        if name in ("semantic", "hybrid") and "embedding" not in queries.columns:
            queries = queries.withColumn("embedding", F.lit(None).cast("array<double>")) if self.embedder is None else with_vectors(queries.withColumnRenamed("query", "content"), self.embedder).withColumnRenamed("content", "query")
        settings = registry.retriever.settings(name, self.conf)
        for reserved in ("queries", "corpus", "k", "where", "vector"):
            settings.pop(reserved, None)
        return registry.retriever.get(name)(queries, self.corpus, k=k, where=where, **settings)


def build_pipeline(spark: SparkSession, conf: dict | None, chunks: DataFrame | None = None, embedder: Callable | None = None, chat: Callable[[str], str] | None = None) -> Pipeline | None:
    """None for an empty or disabled configuration. Chunks that are given stand in for the configured documents."""
    if not conf or not conf.get("enabled", True):
        return None
    registry.load_custom(conf.get("custom_modules") or [])
    chunks = build_chunks(spark, conf, embedder) if chunks is None else chunks
    name, store = conf.get("retriever", "keyword"), None
    if name in ("semantic", "hybrid", "vectorstore") and embedder is not None:
        chunks = with_vectors(chunks, embedder, cache=conf.get("embedding_cache_path"), model=str(conf.get("embedding_model", "default")))
    elif "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
    chunks = chunks.persist()
    if name == "vectorstore":
        section = conf.get("vectorstore") or {}
        store = Store(spark, section.get("backend", "memory"), section.get("path"), embedder)
        store.add(chunks)
    return Pipeline(conf, Corpus(chunks, conf.get("stopwords"), stem=conf.get("stemmer")), embedder, chat, store, rerank.build_scorer(conf.get("rerank")))


def sampled(qrels: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """n golden questions by a seeded draw from their ids in order; all without n."""
    if not n:
        return qrels
    ids = [r.qid for r in qrels.select("qid").distinct().orderBy("qid").collect()]
    picked = random.Random(seed).sample(ids, min(n, len(ids)))
    kind = qrels.schema["qid"].dataType.simpleString()
    return qrels.join(qrels.sparkSession.createDataFrame([(i,) for i in picked], f"qid {kind}"), "qid", "left_semi")


@dataclass
class Report:
    dataset: str
    n: int
    k: int
    per_query: DataFrame
    summary: DataFrame
    dimensions: DataFrame
    overall: dict
    config_hash: str

    def text(self) -> str:
        lines = [f"{self.dataset}: n={self.n}, k={self.k}, config {self.config_hash}"]
        lines += [f"  {r.name:<20} {r.mean:.3f}  [{r.ci_low:.3f}, {r.ci_high:.3f}]" for r in stats.rounded(self.summary).orderBy("name").collect()]
        lines += [f"  {r.dimension:<20} {r.status}" for r in self.dimensions.orderBy("dimension").collect()]
        return "\n".join([*lines, f"overall: {'PASS' if self.overall['overall_pass'] else 'FAIL'} (weighted {self.overall['weighted_score']:.3f}, enough cases: {self.overall['min_n_ok']})"])


def fingerprint(conf: dict, dataset: str, names, k: int, n: int) -> str:
    """Twelve digits over the whole configuration."""
    return hashlib.sha256(json.dumps([conf, dataset, list(names), k, n], sort_keys=True, default=str).encode()).hexdigest()[:12]


def evaluate(pipeline: Pipeline, qrels: DataFrame, dataset: str, k: int = 10, n: int | None = None, seed: int = 42, generate: Callable[[str], str] | None = None, judge: Callable[[str], str] | None = None) -> Report:
    """Ranking metrics, their intervals and the rubric; with `generate`, answers are made and scored as well."""
    cases = sampled(qrels, n, seed).persist()
    results = pipeline.retrieve(cases.select("qid", "query"), k).persist()
    per = metrics.per_query(cases, results, k)
    long = metrics.long_form(per)
    if generate is not None:
        long = long.unionByName(generated_scores(cases, results, k, generate, judge))
    long = long.persist()
    summary = stats.bootstrap(long)
    dimensions = stats.rubric(summary)
    overall = stats.decision(dimensions).collect()[0].asDict()
    count = cases.count()
    summary, dimensions = cut(summary), cut(dimensions)
    for held in (cases, results):
        held.unpersist()
    return Report(dataset, count, k, long, summary, dimensions, overall, fingerprint(pipeline.conf, dataset, metrics.METRICS, k, count))


def generated_scores(cases: DataFrame, results: DataFrame, k: int, generate: Callable[[str], str], judge: Callable[[str], str] | None) -> DataFrame:
    """(qid, name, value) of answers that a chat model gives from the retrieved context; a failed one is empty."""
    contexts = augment.evaluation_context(cases, results)

    @F.pandas_udf("string")
    def answer(context, query):
        out = []
        for c, q in zip(context, query):
            try:
                out.append(generate(f"Answer from the context alone and cite passages as [n].\n\nContext:\n{c}\n\nQuestion: {q}"))
            except Exception:
                out.append("")
        return type(context)(out)

    sources = results.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("source", "doc_id").alias("source")))), lambda x: x["source"]).alias("sources"))
    rows = cases.join(contexts, "qid").join(sources, "qid", "left").withColumn("answer", answer("context", "query"))
    names = {
        "citation_precision": answer_scores.citation_precision(F.col("answer"), F.col("sources"), k),
        "answer_correctness": answer_scores.judged_score(F.col("answer"), F.col("expected_answer"), judge),
        "abstention": answer_scores.abstention(F.col("answer"), F.col("out_of_scope")),
    }
    scored = rows.select("qid", *[c.alias(n) for n, c in names.items()]).unpivot("qid", list(names), "name", "value")
    if judge is not None:
        scored = scored.unionByName(answer_scores.faithfulness(rows, judge).select("qid", F.lit("faithfulness").alias("name"), "value"))
    return scored


def compare(a: Pipeline, b: Pipeline, qrels: DataFrame, metric: str = "recall", k: int = 10, n: int | None = None, seed: int = 42) -> DataFrame:
    name = metrics.metric_name(metric)
    cases = sampled(qrels, n, seed).persist()
    long = [metrics.long_form(metrics.per_query(cases, p.retrieve(cases.select("qid", "query"), k), k), [name]) for p in (a, b)]
    return stats.compare(*long)
