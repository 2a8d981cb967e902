"""p5: the most similar vectors for every vector.

Every vector is coded in four bits for each pair of its coordinates: the residual to its cell's centre, under a
score-aware loss. The codes (16 bytes for 64 numbers) go to the vector's nearest cells; only to the home cell goes
the vector itself, which asks there. A cell is searched by table scans: each asking vector's products with the
code words stand in tables, and the tables' entries for a code add up to its score. What the scan leaves over is
ranked by the exact cosine, for candidates of the home cell at once, for those of other cells, if their score may
still matter, after their vectors have been fetched by a join. Cells with very many vectors are searched in blocks
of asking vectors. Centres and code words are fitted on a bounded sample; every vector is indexed.

Vectors of one direction are met once; copies get their own rows at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.runtime import cores, cut, shuffle_width, spread
from quarry.llm.quantiser import CellIndex


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the lists that are exactly dim numbers, all finite and not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(u: np.ndarray) -> np.ndarray:
    """Signed 64-bit key of each direction, to 12 decimals."""
    r = np.round(u, 12) + 0.0
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in r], np.uint64).astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as two-byte decimals if that loses nothing, else as it is."""
    y = np.round(x * 1e4)
    short = (np.abs(y).max(1, initial=0) < 32768) & (y / 1e4 == x).all(1)
    small = np.where(short[:, None], y, 0).astype("<i2")
    return [s.tobytes() if ok else v.tobytes() for s, v, ok in zip(small, x.astype("<f8"), short.tolist())]


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers from `pack`; the length tells the kind."""
    out = np.zeros((len(column), dim))
    blobs = column.to_pylist()
    short = np.array([len(b) == 2 * dim for b in blobs], bool)
    for kind, scale, mine in (("<i2", 1e4, short), ("<f8", 1.0, ~short)):
        if mine.any():
            out[mine] = np.frombuffer(b"".join(b for b, m in zip(blobs, mine.tolist()) if m), kind).reshape(-1, dim) / scale
    return out


def vectors(rows: DataFrame, dim: int, keep: int) -> DataFrame:
    """(key, v, ids): each direction once, with the least `keep` ids that have it.

    The window's limit works before its shuffle, so a direction that a third of all rows share doesn't travel.
    """

    def read(batches):
        for b in batches:
            at, x = usable(b.column(1), dim)
            key = directions(unit(x))
            ids = b.column(0).take(pa.array(at))
            once = np.array(sorted({pair: j for j, pair in enumerate(zip(key.tolist(), ids.to_pylist()))}.values()), np.int64)
            take = pa.array(once)
            yield pa.RecordBatch.from_arrays([pa.array(key[once]), ids.take(take), pa.array(pack(x[once]), pa.binary())], ["key", "id", "v"])

    ranked = rows.mapInArrow(read, "key long, id string, v binary").withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("id")))
    return ranked.where(F.col("r") <= keep).groupBy("key").agg(F.min("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))


def search_cell(index: CellIndex, cell: int, table: pa.Table, dim: int, k: int, least: float, rerank: int, afar: int, block: int = 256):
    """(ask, candidate, cosine) of one cell: cosine is exact for candidates at home here, missing for others, of which
    the `afar` best scores may be fetched."""
    key = table.column("key").to_numpy()
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
    home = table.column("v").is_valid().to_numpy(zero_copy_only=False)
    asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
    at_home = np.flatnonzero(home)
    u = np.zeros((len(key), dim))
    u[at_home] = unit(unpack(table.column("v").combine_chunks().take(pa.array(at_home)), dim))
    n = min(rerank, len(key))
    out = [[], [], []]
    for a in range(0, len(asks), block):
        mine = asks[a : a + block]
        score, low, scale = index.scan(cell, u[mine], code)
        # Everything that may reach `least`; where that is more than `rerank`, the best of it.
        floor = np.clip(np.floor((least - index.margin - low) * scale), 0, 65535).astype(np.uint16)
        if n < len(key):
            floor = np.maximum(floor, np.partition(score, len(key) - n, axis=1)[:, len(key) - n])
        q, d = np.nonzero(score >= floor[:, None])
        other = key[d] != key[mine[q]]
        q, d = q[other], d[other]
        near = home[d]
        exact = np.full(len(q), np.nan)
        exact[near] = np.einsum("nd,nd->n", u[mine[q[near]]], u[d[near]])
        # The k-th best at home is a bound for the cells around it.
        order = np.lexsort((-np.nan_to_num(exact, nan=-9.0), q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        kth = np.full(len(mine), least)
        at_k = order[(rank == k - 1) & near[order]]
        kth[q[at_k]] = np.maximum(exact[at_k], least)
        approx = score[q, d] / scale[q] + low[q]
        far = np.lexsort((-approx, near, q))
        place = np.arange(len(q)) - np.searchsorted(q[far], q[far])
        best = np.zeros(len(q), bool)
        best[far[place < afar]] = True
        good = np.where(near, np.round(exact, 10) >= np.round(kth[q], 10), best & (approx >= kth[q] - index.margin))
        for column, value in zip(out, (key[mine[q[good]]], key[d[good]], exact[good])):
            column.append(value)
    ask, cand, cos = (np.concatenate(c) if c else np.zeros(0) for c in out)
    return pa.table([pa.array(ask.astype(np.int64)), pa.array(cand.astype(np.int64)), pa.array(cos, pa.float64(), mask=np.isnan(cos))], ["ask", "cand", "cosine"])


def nearest(df: DataFrame, id_col: str, vector_col: str, k: int = 5, dim: int = 64, least: float = -2.0, cell_size: int = 2000, copies: int = 3, rerank: int = 64, sample: int = 65_536, threshold: float = 0.6) -> DataFrame:
    """(id, neighbour, cosine, rank): for each id with a usable vector its k most similar other ids with a cosine
    of at least `least`; equal cosines (to 10 decimals) rank by smaller id.

    Usable vectors have dim numbers, all finite and not all zero; others, and rows with a null id, neither ask nor
    answer. An id given twice counts once. Cells are as many as vectors / cell_size, fitted on about `sample`
    vectors chosen by a hash; each vector is in `copies` cells; the `rerank` best scores of a cell are candidates: those at home there are ranked
    exactly at once, of the others the 3k best whose scores may still matter.
    """
    spark = df.sparkSession
    rows = spread(df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL"))
    schema = "id string, neighbour string, cosine double, rank int"
    known = cut(vectors(rows, dim, k + 1))
    total = known.count()
    if not total:
        return spark.createDataFrame([], schema)
    limit = F.lit(min(1.0, sample / total) * 2.0**63)
    picked = known.where(F.xxhash64("key").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") <= limit).select("v")
    drawn = picked.toArrow().column("v")
    fitted = CellIndex(unit(unpack(drawn, dim)), total, cell_size, copies, threshold)
    index = spark.sparkContext.broadcast(fitted)

    def deal(batches):
        for b in batches:
            key, v = b.column(0).to_numpy(), b.column(1)
            u = unit(unpack(v, dim))
            cells, codes = index.value.place(u)
            parts = index.value.blocks_of(cells)
            # A vector's codes go to every block of a cell; it asks in one of those of its home.
            row, turn = np.nonzero(np.ones_like(cells, bool))
            times = parts.ravel()
            row, turn = np.repeat(row, times), np.repeat(turn, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            mine = turn == 0
            asks = mine & (block == (key.astype(np.uint64)[row] % parts[row, turn].astype(np.uint64)).astype(np.int64))
            blobs = [x.tobytes() for x in codes.reshape(-1, codes.shape[-1])]
            columns = [
                pa.array(cells[row, turn], pa.int64()),
                pa.array(block, pa.int32()),
                pa.array(key[row]),
                pa.array(asks),
                pa.array(blobs, pa.binary()).take(pa.array(row * cells.shape[1] + turn)),
                v.take(pa.array(np.where(mine, row, 0), mask=~mine)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "block", "key", "asks", "code", "v"])

    def search(group, table):
        return search_cell(index.value, group[0].as_py(), table, dim, k, least, rerank, 3 * k)

    width = max(shuffle_width(spark), 4 * cores(spark), fitted.cells // 64)
    placed = known.select("key", "v").mapInArrow(deal, "cell long, block int, key long, asks boolean, code binary, v binary").repartition(width, "cell", "block")
    met = cut(placed.groupBy("cell", "block").applyInArrow(search, "ask long, cand long, cosine double"))

    def measure(batches):
        for b in batches:
            cos = np.einsum("nd,nd->n", unit(unpack(b.column(2), dim)), unit(unpack(b.column(3), dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos)], ["a", "b", "cosine"])

    afar = met.where("cosine IS NULL").select(F.least("ask", "cand").alias("a"), F.greatest("ask", "cand").alias("b")).distinct()
    afar = afar.join(known.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(known.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    afar = afar.select("a", "b", "va", "vb").mapInArrow(measure, "a long, b long, cosine double").where(F.col("cosine") >= least)
    both = afar.select(F.explode(F.array(F.struct(F.col("a").alias("ask"), F.col("b").alias("cand")), F.struct(F.col("b").alias("ask"), F.col("a").alias("cand")))).alias("p"), "cosine")
    # Two vectors have one home or two, and each asks once: no pair is among both.
    pairs = met.where(F.col("cosine") >= least).unionByName(both.select("p.*", "cosine"))
    best = pairs.withColumn("r", F.rank().over(Window.partitionBy("ask").orderBy(F.round("cosine", 10).desc()))).where(F.col("r") <= k)

    def entries(cosine):
        return F.transform("ids", lambda i: F.struct((-F.round(cosine, 10)).alias("c"), i.alias("n"), cosine.alias("x")))

    named = best.join(known.select(F.col("key").alias("cand"), "ids"), "cand").select("ask", entries(F.col("cosine")).alias("e"))
    others = named.groupBy(F.col("ask").alias("key")).agg(F.flatten(F.collect_list("e")).alias("e"))
    own = entries(F.lit(1.0))
    lists = known.select("key", "ids").join(others, "key", "left").select("key", F.slice(F.array_sort(F.concat(own, F.coalesce("e", F.slice(own, 1, 0)))), 1, k + 1).alias("e"))

    def member_keys(batches):
        for b in batches:
            at, x = usable(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(directions(unit(x)), pa.int64()), b.column(0).take(pa.array(at))], ["key", "id"])

    mine = rows.mapInArrow(member_keys, "key long, id string").distinct().join(lists.where(F.size("e") > 1), "key")
    return mine.select("id", F.posexplode(F.slice(F.filter("e", lambda x: x["n"] != F.col("id")), 1, k)).alias("rank", "x")).select("id", F.col("x.n").alias("neighbour"), F.col("x.x").alias("cosine"), (F.col("rank") + 1).cast("int").alias("rank"))


def similar_neighbour_pairs(near: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once, with a cosine of at least `least`."""
    return near.where(F.col("cosine") >= least).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
