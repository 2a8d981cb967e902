"""Clients of models outside: embeddings and chat over HTTP, and stand-ins without keys. All can be pickled."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import errors
from quarry.functions import text
from quarry.functions.runtime import exists

RETRY = (429, 500, 502, 503, 529)


def post(url: str, body: dict, key: str = "", timeout: float = 60.0, retries: int = 2, sleep=time.sleep, opener=urllib.request.urlopen) -> dict:
    """JSON answer; passing errors are tried again after 1, 2, ... seconds or what the server asks for."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for attempt in range(retries + 1):
        try:
            with opener(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
                raw = answer.read()
            break
        except urllib.error.HTTPError as e:
            if e.code in RETRY and attempt < retries:
                wait = e.headers.get("Retry-After") if e.headers else None
                sleep(float(wait) if wait and wait.replace(".", "", 1).isdigit() else 2.0**attempt)
                continue
            kind = errors.ModelAuthError if e.code in (401, 403) else errors.ModelRateError if e.code == 429 else errors.ModelServerError if e.code >= 500 else errors.ModelRequestError
            raise kind(f"{e.code} from {url}") from e
        except OSError as e:
            if attempt < retries:
                sleep(2.0**attempt)
                continue
            raise errors.ModelServerError(str(e)) from e
    try:
        return json.loads(raw)
    except ValueError as e:
        raise errors.ModelAnswerError(f"no JSON from {url}") from e


class HttpEmbedder:
    """Embeddings of an OpenAI-compatible service; a slot that failed is None."""

    def __init__(self, model: str, base_url: str, api_key: str = "", batch: int = 64):
        self.model, self.base_url, self.api_key, self.batch = model, base_url.rstrip("/"), api_key, batch

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for a in range(0, len(texts), self.batch):
            part = texts[a : a + self.batch]
            slots: list[list[float] | None] = [None] * len(part)
            try:
                for row in post(f"{self.base_url}/embeddings", {"model": self.model, "input": part}, self.api_key).get("data", []):
                    slots[row["index"]] = row["embedding"]
            except Exception:
                pass
            out += slots
        return out


class BagEmbedder:
    """Bag of words over 128 buckets of their md5: deterministic, without a key."""

    dim = 128

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", (t or "").lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1.0
            out.append(v)
        return out


def bag_embedding(column: Column, dim: int = 128) -> Column:
    """The same vector as a column, in Arrow batches; each word of a batch is hashed once."""

    @F.arrow_udf("array<double>")
    def run(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], np.int64)
        rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        counts = np.bincount(rows * dim + bucket[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(lists) * dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(counts.astype(np.float64)))

    return run.asNondeterministic()(text.tokens(column))  # it isn't, but a filter on the vector would make it twice


def embed_column(embedder: Callable[[list[str]], list]):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder(texts.fillna("").tolist()), dtype=object)

    return run


def with_vectors(chunks: DataFrame, embedder: Callable[[list[str]], list], vector: str = "embedding", cache: str | None = None, model: str = "default") -> DataFrame:
    """Vectors for the chunks that lack one; each distinct content is embedded once, and met again by its hash. A
    null content is embedded as an empty one. With a cache folder only contents new to it are embedded."""
    if vector not in chunks.columns:
        chunks = chunks.withColumn(vector, F.lit(None).cast("array<double>"))
    keyed = chunks.withColumn("_key", F.when(F.col(vector).isNull(), F.sha2(F.coalesce("content", F.lit("")), 256)))
    missing = keyed.where("_key IS NOT NULL").select(F.coalesce("content", F.lit("")).alias("content"), F.col("_key").alias("key")).dropDuplicates(["key"])
    made = missing.select("key", embed_column(embedder)("content").alias("vector")) if cache is None else cached_vectors(missing, embedder, cache, model)
    joined = keyed.join(made.select(F.col("key").alias("_key"), F.col("vector").alias("_v")), "_key", "left")
    return joined.withColumn(vector, F.coalesce(vector, "_v")).drop("_key", "_v")


def cached_vectors(contents: DataFrame, embedder: Callable[[list[str]], list], folder: str, model: str) -> DataFrame:
    """(key, vector) of contents(content) from a Parquet cache keyed by model and content hash; only new ones are
    made, and those that couldn't be are tried again next time."""
    spark = contents.sparkSession
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9_.-]', '_', model)}"
    wanted = contents.select("content", F.sha2("content", 256).alias("key")).dropDuplicates(["key"])
    new = wanted.join(spark.read.parquet(path).select("key"), "key", "left_anti") if exists(spark, path) else wanted
    new.select("key", embed_column(embedder)("content").alias("vector")).where("vector IS NOT NULL").write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates(["key"]).join(wanted.select("key"), "key", "left_semi")


class HttpChat:
    """First choice of an OpenAI-compatible chat service at temperature 0."""

    def __init__(self, model: str, base_url: str, api_key: str = ""):
        self.model, self.base_url, self.api_key = model, base_url.rstrip("/"), api_key or os.environ.get("OPENAI_API_KEY", "")

    def __call__(self, prompt: str) -> str:
        choices = post(f"{self.base_url}/chat/completions", {"model": self.model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}, self.api_key).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""


class PatternChat:
    """Answers by the first pattern found in the prompt, else the default; without state, so safe on executors."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def __call__(self, prompt: str) -> str:
        return next((a for p, a in self.answers.items() if re.search(p, prompt)), self.default)
