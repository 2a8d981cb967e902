"""Vector stores: tables of chunks with vectors that are added to and searched by cosine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.models import with_vectors
from quarry.functions.runtime import cut, hadoop_path
from quarry.operators.index import Corpus
from quarry.operators.retrieve import semantic

BACKENDS = ("memory", "faiss", "chroma", "pgvector")


def _latest(rows: DataFrame, generation: str | None) -> DataFrame:
    """One row for each id, the one of the latest generation."""
    order = Window.partitionBy("id").orderBy(F.desc(generation) if generation else F.lit(1))
    kept = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    return kept.drop(generation) if generation else kept


class Store:
    """One store class for every backend name: exact cosine, filters before the cut, upsert by id.

    With a path the chunks live in Parquet there and survive the session, else in the session.
    """

    def __init__(self, spark: SparkSession, backend: str = "memory", path: str | None = None, embedder: Callable | None = None):
        if backend not in BACKENDS:
            raise ConfigError(f"no vector store {backend!r}")
        self.spark, self.backend, self.path, self.embedder = spark, backend, path, embedder
        self._chunks: DataFrame | None = None

    def _generations(self) -> list[str]:
        p, fs = hadoop_path(self.spark, self.path)
        names = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])]
        return sorted(n for n in names if n.startswith("generation-"))

    def _stored(self) -> DataFrame | None:
        """The latest of each id."""
        if not self.path:
            return self._chunks
        rows = [self.spark.read.parquet(f"{self.path}/{g}").withColumn("_g", F.lit(i)) for i, g in enumerate(self._generations())]
        if not rows:
            return None
        together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        return together.drop("_g") if len(rows) == 1 else _latest(together, "_g")

    def add(self, chunks: DataFrame) -> None:
        """Embeds chunks without vectors; ids known already are replaced, chunks that can't be embedded left out.

        With a path each addition is a generation of its own beside the older ones; `compact` makes them one.
        """
        if self.embedder is not None:
            chunks = with_vectors(chunks, self.embedder)
        chunks = _latest(chunks.where(F.size("embedding") > 0), None)
        if self.path:
            held = self._generations()
            chunks.write.parquet(f"{self.path}/generation-{int(held[-1].split('-')[1]) + 1 if held else 1:06d}")
            return
        old = self._chunks
        both = chunks if old is None else _latest(chunks.withColumn("_g", F.lit(1)).unionByName(old.withColumn("_g", F.lit(0)), allowMissingColumns=True), "_g")
        self._chunks = cut(both)

    def compact(self) -> None:
        """Writes the latest of each id as one generation and drops those before it."""
        held = self._generations() if self.path else []
        if len(held) > 1:
            self._stored().write.parquet(f"{self.path}/generation-{int(held[-1].split('-')[1]) + 1:06d}")
            for name in held:
                p, fs = hadoop_path(self.spark, f"{self.path}/{name}")
                fs.delete(p, True)

    def count(self) -> int:
        rows = self._stored()
        return 0 if rows is None else rows.count()

    def search(self, queries: DataFrame, k: int = 5, where: dict | None = None) -> DataFrame:
        """queries(qid, query[, embedding]); those that have no vector find nothing."""
        rows = self._stored()
        method = f"vectorstore:{self.backend}"
        if "embedding" not in queries.columns:
            if self.embedder is None:
                queries = queries.withColumn("embedding", F.lit(None).cast("array<double>"))
            else:
                queries = with_vectors(queries.withColumnRenamed("query", "content"), self.embedder).withColumnRenamed("content", "query")
        if rows is None:
            return semantic(queries.limit(0), Corpus(queries.limit(0).select(F.lit("").alias("id"), "embedding")), k, method=method)
        return semantic(queries, Corpus(rows), k, where, method=method)
