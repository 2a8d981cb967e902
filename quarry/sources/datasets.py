"""Golden questions: qrels(qid, query, gold_doc, gold_needles, expected_answer, out_of_scope), and corpus builders."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions import text

QRELS = "qid long, query string, gold_doc string, gold_needles array<string>, expected_answer string, out_of_scope boolean"

#: The built-in corpus and its questions.
CORPUS = (
    ("doc_mitochondria", "The mitochondrion is the powerhouse of the cell, producing ATP via oxidative phosphorylation."),
    ("doc_photosynthesis", "Photosynthesis converts sunlight into chemical energy stored as glucose in plant chloroplasts."),
    ("doc_gravity", "Gravity is the force that attracts two masses toward each other; it gives objects weight on Earth."),
    ("doc_water_cycle", "The water cycle describes evaporation, condensation, and precipitation moving water through the biosphere."),
    ("doc_dna", "DNA carries the genetic instructions for life and is composed of four nucleotide bases arranged in a double helix."),
    ("doc_volcano", "A volcano is a rupture in the crust that allows molten magma, ash, and gases to escape from below the surface."),
)
QUESTIONS = (
    ("what produces ATP in the cell", "doc_mitochondria", "powerhouse of the cell"),
    ("how do plants make energy", "doc_photosynthesis", "converts sunlight into chemical energy"),
    ("what force attracts two masses together", "doc_gravity", "force that attracts two masses"),
    ("how does water move through nature", "doc_water_cycle", "evaporation, condensation"),
    ("what molecule stores genetic information", "doc_dna", "genetic instructions"),
)


def synthetic_chunks(spark: SparkSession) -> DataFrame:
    rows = [(f"c_{d}", d, c, d) for d, c in CORPUS]
    return spark.createDataFrame(rows, "id string, doc_id string, content string, source string")


def synthetic_qrels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, d, [n], None, False) for i, (q, d, n) in enumerate(QUESTIONS)], QRELS)


def json_qrels(spark: SparkSession, path: str) -> tuple[str, DataFrame, str | None]:
    """Name, questions and corpus folder of {name, corpus_dir, qrels: [...]}; a single needle may be a string."""
    data = json.loads(Path(path).read_text())
    rows = []
    for i, q in enumerate(data.get("qrels", [])):
        needles = q.get("gold_needles") or []
        rows.append((i, q["query"], q.get("gold_doc") or q.get("doc_id"), [needles] if isinstance(needles, str) else list(needles), q.get("expected_answer"), bool(q.get("out_of_scope", False))))
    return data.get("name", Path(path).stem), spark.createDataFrame(rows, QRELS), data.get("corpus_dir")


def csv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Columns query, gold_doc, gold_needles or needles (parted by |), expected_answer."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    column = lambda *names: next((F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    needles = F.filter(F.transform(F.split(F.coalesce(column("gold_needles", "needles"), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.monotonically_increasing_id().alias("qid"), column("query").alias("query"), column("gold_doc").alias("gold_doc"), needles.alias("gold_needles"), column("expected_answer").alias("expected_answer"), F.lit(False).alias("out_of_scope"))


def resolve(spark: SparkSession, name: str, path: str | None = None) -> tuple[str, DataFrame, str | None]:
    """synthetic; json or byo and csv with a path; msmarco and tydi-id from the JSON files that the builders write,
    by default those in the folder QUARRY_DATASETS."""
    if name == "synthetic":
        return "synthetic", synthetic_qrels(spark), None
    own = {"msmarco": "msmarco", "tydi-id": "tydi-id", "tydi_id": "tydi-id", "tydi": "tydi-id"}.get(name)
    if own:
        path = path or str(Path(os.environ.get("QUARRY_DATASETS", "datasets")) / f"{own}.json")
        if not Path(path).exists():
            raise ConfigError(f"dataset {own} isn't at {path}; the corpus builders write it")
        return own, *json_qrels(spark, path)[1:]
    if name in ("json", "byo") and path:
        return json_qrels(spark, path)
    if name == "csv" and path:
        return Path(path).stem, csv_qrels(spark, path), None
    raise ConfigError(f"no dataset {name!r}, or it needs a path")


def passage_corpus(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corpus and questions of passages(qid, query, text, selected, pos): each passage once, by a hash of its text; a
    question's gold is its first selected passage, its needle the first ten words of that passage's first 200 letters."""
    rows = passages.withColumn("doc_id", text.passage_id(F.col("text")))
    corpus = rows.select("doc_id", F.col("text").alias("content")).dropDuplicates(["doc_id"])
    gold = rows.where("selected").groupBy("qid").agg(F.min_by(F.struct("query", "doc_id", "text"), "pos").alias("g"))
    needle = text.snippet(F.substring("g.text", 1, 200))
    return corpus, gold.select("qid", "g.query", F.col("g.doc_id").alias("gold_doc"), F.array(needle).alias("gold_needles"), F.lit(None).cast("string").alias("expected_answer"), F.lit(False).alias("out_of_scope"))


def drawn(key, seed: int):
    """A repeatable order of a seeded draw."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")))


def answer_corpus(rows: DataFrame, distractors: DataFrame, n: int, density: int = 3000, least: int = 80, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Questions sampled from rows(qid, query, context, answer), their needle the answer's first ten words, and a
    corpus of their contexts filled up to `density` with distractors(text) of at least `least` letters."""
    picked = rows.orderBy(drawn(F.col("qid"), seed), "qid").limit(n)
    own = picked.select(text.passage_id(F.col("context")).alias("doc_id"), F.col("context").alias("content")).dropDuplicates(["doc_id"])
    more = distractors.where(F.length("text") >= least).select(text.passage_id(F.col("text")).alias("doc_id"), F.col("text").alias("content")).dropDuplicates(["doc_id"]).join(own.select("doc_id"), "doc_id", "left_anti")
    fill = max(0, density - own.count())
    qrels = picked.select("qid", "query", text.passage_id(F.col("context")).alias("gold_doc"), F.array(text.snippet(F.col("answer"))).alias("gold_needles"), F.col("answer").alias("expected_answer"), F.lit(False).alias("out_of_scope"))
    return own.unionByName(more.orderBy(drawn(F.col("doc_id"), seed), "doc_id").limit(fill)), qrels
