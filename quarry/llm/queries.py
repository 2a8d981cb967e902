"""Queries pN_... over a data folder, with production parameters and whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import boilerplate, encodings, language, leakage, nearduplicates, neighbours, splitting, tokenize
from quarry.sources.tables import table

TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")


def _wrong_readings(spark: SparkSession, folder: str):
    docs = table(spark, folder, "kb_documents")
    model = encodings.fit_letter_pairs(docs, "content", table(spark, folder, "lang_samples"))
    return docs, model, *encodings.wrong_readings(docs, "doc_id", "content", "source", model)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _wrong_readings(spark, folder)[2].select(F.col("id").alias("doc_id"))


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    docs, model, wrong, tables = _wrong_readings(spark, folder)
    return encodings.restored(docs, "doc_id", "content", wrong, tables, model).withColumnRenamed("id", "doc_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearduplicates.near_duplicate_pairs(table(spark, folder, "chunks"), "id", "content", 0.5).select("id_a", "id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nearduplicates.near_duplicate_groups(table(spark, folder, "chunks"), "id", "content", 0.5)


KB = ("doc_id", "content", "source", "title")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "kb_documents")
    return boilerplate.boilerplate_lines(docs, *KB, boilerplate.fit_line_model(docs, *KB))


def p3_main(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "kb_documents")
    return boilerplate.main_content(docs, *KB, boilerplate.fit_line_model(docs, *KB))


def _cut_table(spark: SparkSession, folder: str, content: bool) -> DataFrame:
    documents = splitting.oversized_ranges(table(spark, folder, "kb_documents"), "doc_id", "content", 2000, "document")
    chunks = splitting.oversized_ranges(table(spark, folder, "chunks"), "id", "content", 1000, "chunk")
    return splitting.cut_ranges(documents.unionByName(chunks), content=content)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_table(spark, folder, False).where(F.size("pieces") > 0).select("item_kind", "item_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_items(_cut_table(spark, folder, True))


def p4_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item amount to: characters covered, and whether size, overlap and cover are kept."""
    before = F.lag("stop").over(Window.partitionBy("item_kind", "item_id").orderBy("piece_no"))
    rows = p4_pieces(spark, folder).withColumn("shared", before - F.col("start"))
    fits = F.max(F.length("content")) <= 1000
    whole = F.bool_and((F.length("content") == F.col("stop") - F.col("start")) & F.coalesce(F.col("shared") >= 0, F.lit(True)))
    kept = rows.groupBy("item_kind", "item_id").agg((F.max("stop") - F.min("start")).alias("n_chars"), fits.alias("fits"), (F.coalesce(F.max("shared"), F.lit(0)) <= 50).alias("overlaps"), whole.alias("whole"))
    return kept


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "chunks"), "id", "embedding", copies=5, rerank=256)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(table(spark, folder, "chunks"), "id", "embedding", least=0.85)
    return neighbours.similar_neighbour_pairs(near, 0.85)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, folder, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_passages(spark, folder).where(F.col("longest_run") >= 12).select("doc_id", "item_id")


def p8_languages(spark: SparkSession, folder: str) -> DataFrame:
    model = language.fit_model(table(spark, folder, "lang_samples"))
    return language.assign_languages(table(spark, folder, "documents"), "doc_id", "text", "lang", model)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_cases(p8_languages(spark, folder), "doc_id")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


#: Exact Jaccard similarity of sets of three consecutive words; a dotted capital I is small i and a combining dot.
PAIRS = r"""
    WITH w AS (SELECT DISTINCT id, regexp_extract_all(lower(replace(content, 'İ', 'i' || chr(775))), '[\p{L}\p{N}_]+') AS ws FROM chunks WHERE content IS NOT NULL),
    s AS (SELECT DISTINCT id, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) AS g FROM w WHERE len(ws) >= 40),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
    c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
    SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE shared >= 0.5 * (x.n + y.n - shared)"""
#: Content without white space at its ends.
STRIPPED = r"regexp_replace(content, '^[\s\x{85}\x{1C}-\x{1F}\p{Z}]+|[\s\x{85}\x{1C}-\x{1F}\p{Z}]+$', '', 'g')"
OVERSIZED = f"""
    SELECT 'document' AS item_kind, doc_id AS item_id, length({STRIPPED}) AS n_chars FROM kb_documents WHERE length({STRIPPED}) > 2000 GROUP BY ALL
    UNION ALL
    SELECT 'chunk', id, length({STRIPPED}) FROM chunks WHERE length({STRIPPED}) > 1000 GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": PAIRS,
        "p4_found": f"SELECT item_kind, item_id FROM ({OVERSIZED})",
        "p4_whole": f"SELECT item_kind, item_id, n_chars, true AS fits, true AS overlaps, true AS whole FROM ({OVERSIZED})",
    }
