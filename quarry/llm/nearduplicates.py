"""p2: pairs and groups of texts that share most of their word shingles.

Vertical partitioning. All shingles are put into one global order, the rarest first; rarity is read from a sketch
of fixed size that counts every shingle of the corpus. Each text's shingles are cut into fragments of this order:
its prefix, without which no partner of the wanted similarity can be had, and the rest. Prefix fragments are
spread over partitions by shingle; each partition meets the texts that share a shingle, drops pairs that the
lengths or an outline of both sets (a string of bits) rule out, and counts the overlap of each other pair in its own
fragment. A group-by sums these partial overlaps for each pair; a pair whose sum, with all that the rest of both
texts could add, stays under the needed overlap is dropped. For the others the fragments of the rest are counted,
the rarest first, and summed under the same bound. The bounds are exact: no pair at or over the threshold is lost
and none under it is given. Only texts of such pairs are fetched, by a filter of their keys.

Copies of a text are met once (by a key of its tokens) and come back at the end.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.runtime import cut, shuffle_width, spread
from quarry.llm.shingles import batch_shingles, text_key, tokens

SKETCH_BITS = 22
SKETCH_SLICES = 32
HOT = 20_000
#: Texts of at least WIDE_FROM shingles fill 256 bits; they carry a second outline.
WIDE_FROM = 110
WIDE_BITS = 1024
FRAGMENTS = 4
FRAGMENT_WIDTH = 24
POSTING = np.dtype([("token", "<u4"), ("doc", "<u4"), ("pos", "<u4")])
TEXT = np.dtype([("key", "<i8"), ("size", "<u4"), ("bits", "<u8", 4)])


# ---- arithmetic of the threshold t = num / den


def overlap_needed(a, b, t: float):
    """Least common shingles of sets of sizes a and b with a Jaccard similarity of t."""
    return np.ceil(np.asarray(t * (a + b) / (1 + t)) - 1e-9).astype(np.int64)


def probe_prefix(n, t: float):
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def index_prefix(n, t: float):
    return n - np.ceil(2 * t * n / (1 + t) - 1e-9).astype(np.int64) + 1


# ---- texts of a batch


def batch_sets(texts: list[str | None], n: int, least_words: int):
    """Distinct texts of the batch with enough words: their keys, and (text number, shingle) rows."""
    seen: dict[int, list[str]] = {}
    for t in texts:
        if t and len(t) >= 2 * least_words - 1:
            words = tokens(t)
            if len(words) >= least_words:
                seen.setdefault(text_key(words), words)
    owner, h = batch_shingles(list(seen.values()), n)
    return np.array(list(seen), np.int64), owner, h


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(df: DataFrame, text_col: str, n: int, least_words: int) -> np.ndarray:
    """How many texts hold a shingle of each of 2^22 buckets, as a byte on a logarithmic scale.

    Every text counts. A task's counts, a dense table of fixed size, are packed in slices; slices are summed by
    slice, and 4 MB in all reach the driver whatever the corpus.
    """
    width = (1 << SKETCH_BITS) // SKETCH_SLICES

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            _, _, h = batch_sets(b.column(0).to_pylist(), n, least_words)
            at, c = np.unique(bucket(h), return_counts=True)
            total[at] += c.astype(np.uint32)
        packed = [zlib.compress(total[s * width : (s + 1) * width].tobytes(), 1) for s in range(SKETCH_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sums.setdefault(s, np.zeros(width, np.uint64))
                own += np.frombuffer(zlib.decompress(blob), np.uint32)
        scaled = {s: np.where(x < 2, x, 2 + 8 * np.log2(np.maximum(x, 2) / 2)).clip(0, 255).astype(np.uint8) for s, x in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(scaled), pa.int32()), pa.array([x.tobytes() for x in scaled.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    parts = df.select(text_col).mapInArrow(count, schema).repartition(min(SKETCH_SLICES, shuffle_width(df.sparkSession)), "slice")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for s, blob in parts.mapInArrow(add, schema).collect():
        out[s * width : (s + 1) * width] = np.frombuffer(blob, np.uint8)
    return out


def ordered(owner: np.ndarray, h: np.ndarray, rarity: np.ndarray, texts: int):
    """Shingles of each text in the global order, with their positions and the texts' sizes."""
    rank = rarity[bucket(h)]
    order = np.lexsort((h, rank, owner))
    h, rank = h[order], rank[order]
    size = np.bincount(owner, minlength=texts)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    return h, rank, pos, size


def outline(owner: np.ndarray, h: np.ndarray, texts: int, width: int) -> np.ndarray:
    """A string of bits for each text, in 64-bit words; each shingle sets one of them."""
    bits = np.zeros((texts, width), bool)
    bits[owner, (h % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def prefix_fragments(texts: list[str | None], rarity: np.ndarray, n: int, least_words: int, t: float, parts: int):
    """(partition, packed texts, packed postings, wide outlines of the larger texts) of a batch."""
    keys, owner, h0 = batch_sets(texts, n, least_words)
    if not len(keys):
        return
    h, rank, pos, size = ordered(owner, h0, rarity, len(keys))
    bits = outline(owner, h0, len(keys), 256)
    large = size >= WIDE_FROM
    wide_at = np.cumsum(large) - 1
    of_large = large[owner]
    wide = outline(wide_at[owner[of_large]], h0[of_large], int(large.sum()), WIDE_BITS)
    # A bucket that counts one text holds no shingle of two.
    use = (pos < probe_prefix(size, t)[owner]) & (rank > 1)
    h, rank, pos, owner = h[use], rank[use], pos[use], owner[use]
    token = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    # Lists of very frequent shingles are dealt in blocks: a text goes to all units of its block.
    count = 2.0 ** ((rank.astype(float) - 2) / 8 + 1)
    blocks = np.ceil(count / HOT).astype(np.int64)
    hot = np.flatnonzero(blocks > 1)
    if len(hot):
        extra_at = np.repeat(hot, blocks[hot])
        turn = np.arange(len(extra_at)) - np.repeat(np.cumsum(blocks[hot]) - blocks[hot], blocks[hot])
        mine = (keys[owner[extra_at]].astype(np.uint64) % blocks[extra_at].astype(np.uint64)).astype(np.int64)
        lo, hi = np.minimum(mine, turn), np.maximum(mine, turn)
        unit = (lo * 1_000_003 + hi + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cold = blocks <= 1
        token = np.concatenate([token[cold], token[extra_at] ^ (unit >> np.uint64(32)).astype(np.uint32)])
        pos = np.concatenate([pos[cold], pos[extra_at]])
        owner = np.concatenate([owner[cold], owner[extra_at]])
    part = token.astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        at = order[edges[p] : edges[p + 1]]
        if len(at):
            docs, local = np.unique(owner[at], return_inverse=True)
            head = np.zeros(len(docs), TEXT)
            head["key"], head["size"], head["bits"] = keys[docs], size[docs], bits[docs]
            posts = np.zeros(len(at), POSTING)
            posts["token"], posts["doc"], posts["pos"] = token[at], local, pos[at]
            yield p, head.tobytes(), posts.tobytes(), wide[wide_at[docs[size[docs] >= WIDE_FROM]]].tobytes()


def meeting_pairs(heads: list[bytes], posts: list[bytes], wides: list[bytes], t: float, block: int = 2_000_000):
    """(key_a, key_b, size_a, size_b) of the pairs that meet in a partition and aren't ruled out, each once, and how
    many shingles of the partition's fragment they share (never less than that)."""
    tables = [np.frombuffer(x, TEXT) for x in heads]
    base = np.cumsum([0] + [len(x) for x in tables])
    text = np.concatenate(tables)
    rows = [np.frombuffer(x, POSTING) for x in posts]
    token = np.concatenate([r["token"] for r in rows])
    doc = np.concatenate([r["doc"].astype(np.int64) + base[i] for i, r in enumerate(rows)])
    pos = np.concatenate([r["pos"].astype(np.int64) for r in rows])
    size, key = text["size"].astype(np.int64)[doc], text["key"][doc]
    order = np.lexsort((pos, key, size, token))
    token, doc, pos, size, key = token[order], doc[order], pos[order], size[order], key[order]
    if len(token):  # copies of a text from several batches
        new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, doc, pos, size, key = token[new], doc[new], pos[new], size[new], key[new]
    n = len(token)
    ends = np.searchsorted(token, token, side="right")
    # Within a list sizes ascend: partners of i follow it, up to the size bound.
    big = size.max(initial=0) + 1
    joined = token.astype(np.uint64) * np.uint64(big) + size.astype(np.uint64)
    longest = np.minimum(np.floor(size / t + 1e-9).astype(np.int64), big - 1)
    stop = np.minimum(ends, np.searchsorted(joined, token.astype(np.uint64) * np.uint64(big) + longest.astype(np.uint64), side="right"))
    reach = np.where(pos < index_prefix(size, t), np.maximum(stop - np.arange(n) - 1, 0), 0)
    bits = np.ascontiguousarray(text["bits"])
    wide = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, WIDE_BITS // 64) for x in wides])
    wide_at = np.cumsum(text["size"] >= WIDE_FROM) - 1
    cum = np.cumsum(reach)
    out = []
    i = 0
    while i < n:
        j = int(np.searchsorted(cum, (cum[i - 1] if i else 0) + block, side="right"))
        j = max(j, i + 1)
        left = np.repeat(np.arange(i, j), reach[i:j])
        if len(left):
            turn = np.arange(len(left)) - np.repeat(np.cumsum(reach[i:j]) - reach[i:j], reach[i:j])
            right = left + 1 + turn
            need = overlap_needed(size[left], size[right], t)
            da, db = doc[left], doc[right]
            differ = np.bitwise_count(bits[da] ^ bits[db]).sum(1, dtype=np.int64)
            ok = size[left] + size[right] - differ >= 2 * need
            left, right, need = left[ok], right[ok], need[ok]
            big_pair = np.flatnonzero(size[left] >= WIDE_FROM)  # the right one is no smaller
            differ = np.bitwise_count(wide[wide_at[doc[left[big_pair]]]] ^ wide[wide_at[doc[right[big_pair]]]]).sum(1, dtype=np.int64)
            ok = np.ones(len(left), bool)
            ok[big_pair] = size[left[big_pair]] + size[right[big_pair]] - differ >= 2 * need[big_pair]
            left, right = left[ok], right[ok]
            turned = key[left] > key[right]
            a, b = np.where(turned, right, left), np.where(turned, left, right)
            out.append(np.stack([key[a], key[b], size[a], size[b]], axis=1))
        i = j
    if not out:
        return np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(out), axis=0, return_counts=True)


# ---- exact counting


def fragments(texts: list[str], rarity: np.ndarray, n: int) -> list[tuple[list[frozenset], list[int]]]:
    """Shingles of each text in FRAGMENTS pieces of the global order, and how many are left from each piece on."""
    owner, h = batch_shingles([tokens(t) for t in texts], n)
    piece = np.minimum(rarity[bucket(h)].astype(np.int64) // FRAGMENT_WIDTH, FRAGMENTS - 1)
    order = np.lexsort((piece, owner))
    owner, h, piece = owner[order], h[order].tolist(), piece[order]
    edges = np.searchsorted(owner * FRAGMENTS + piece, np.arange(len(texts) * FRAGMENTS + 1))
    out = []
    for i in range(len(texts)):
        cuts = edges[i * FRAGMENTS : (i + 1) * FRAGMENTS + 1].tolist()
        out.append(([frozenset(h[a:b]) for a, b in zip(cuts, cuts[1:])], [cuts[-1] - a for a in cuts]))
    return out


def similar(a, b, t: float) -> float | None:
    """Jaccard similarity by summed partial overlaps, None as soon as it can't reach t."""
    (pa_, ra), (pb, rb) = a, b
    total = ra[0] + rb[0]
    need, common = math.ceil(t * total / (1 + t) - 1e-9), 0
    for f in range(FRAGMENTS):
        if common + min(ra[f], rb[f]) < need:
            return None
        common += len(pa_[f] & pb[f])
    return common / (total - common) if common >= need else None


def _pack(rows: list[tuple[int, str]]) -> bytes:
    keys = np.array([k for k, _ in rows], "<i8").tobytes()
    return zlib.compress(len(rows).to_bytes(4, "little") + keys + "\0".join(t for _, t in rows).encode(), 1)


def _unpack(blob: bytes) -> list[tuple[int, str]]:
    data = zlib.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    return list(zip(np.frombuffer(data[4 : 4 + 8 * n], "<i8").tolist(), data[4 + 8 * n :].decode().split("\0")))


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys.astype(np.uint64) % np.uint64(parts)).astype(np.int64)


def _grouped(batches):
    """(kind, blobs) by place of a whole partition."""
    out: dict[int, dict[int, list[bytes]]] = {}
    for b in batches:
        for p, kind, blob in zip(*(b.column(i).to_pylist() for i in range(3))):
            out.setdefault(p, {}).setdefault(kind, []).append(blob)
    return out


def _packed(rows):
    p, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["place", "kind", "blob"])


PACKED = "place int, kind int, blob binary"


def enough_shared(met: DataFrame, t: float) -> DataFrame:
    """(key_a, key_b): partial overlaps summed for each pair; what the prefixes don't hold is bounded by the rest of
    the smaller text after its index prefix or of the larger one after its probe prefix."""
    summed = met.groupBy("key_a", "key_b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.sum("shared").alias("shared"))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    rest = F.greatest(F.ceil(2 * t * small / (1 + t) - 1e-9), F.ceil(t * large - 1e-9)) - 1
    return summed.where(F.col("shared") + rest >= F.ceil(t * (small + large) / (1 + t) - 1e-9)).select("key_a", "key_b")


def key_filter(pairs: DataFrame, least_bits: int = 20, most_bits: int = 27) -> np.ndarray:
    """Which remainders of keys occur in the pairs: about sixteen places for each key up to 2^most_bits of them,
    128 MB. Beyond, more texts pass that no pair asks for; none is lost."""
    bits = int(np.clip(np.ceil(np.log2(32 * max(pairs.count(), 1))), least_bits, most_bits))
    width = (1 << bits) // SKETCH_SLICES

    def mark(batches):
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            for k in (0, 1):
                seen[b.column(k).to_numpy() & ((1 << bits) - 1)] = True
        packed = [zlib.compress(np.packbits(seen[s * width : (s + 1) * width]).tobytes(), 1) for s in range(SKETCH_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "marks"])

    def join(batches):
        all_: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = all_.setdefault(s, np.zeros(width // 8, np.uint8))
                own |= np.frombuffer(zlib.decompress(blob), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(all_), pa.int32()), pa.array([x.tobytes() for x in all_.values()], pa.binary())], ["slice", "marks"])

    schema = "slice int, marks binary"
    out = np.zeros(1 << bits, bool)
    for s, blob in pairs.mapInArrow(mark, schema).repartition(min(SKETCH_SLICES, shuffle_width(pairs.sparkSession)), "slice").mapInArrow(join, schema).collect():
        out[s * width : (s + 1) * width] = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
    return out


def similar_pairs(df: DataFrame, text_col: str, t: float, n: int = 3, least_words: int = 40) -> DataFrame:
    """(key_a, key_b, similarity) of different token sequences, key_a < key_b, with a Jaccard similarity of their
    sets of n consecutive words of at least t; texts of fewer than least_words words, and null ones, have none."""
    spark = df.sparkSession
    rows = spread(df.select(text_col))
    rarity = spark.sparkContext.broadcast(count_sketch(rows, text_col, n, least_words))
    parts = shuffle_width(spark)

    def deal(batches):
        for b in batches:
            yield _packed([(p, k, x) for p, *blobs in prefix_fragments(b.column(0).to_pylist(), rarity.value, n, least_words, t, parts) for k, x in enumerate(blobs)])

    def meet(batches):
        for own in _grouped(batches).values():
            pairs, shared = meeting_pairs(own[0], own[1], own[2], t)
            yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k]) for k in range(4)), pa.array(shared.astype(np.int64))], ["key_a", "key_b", "size_a", "size_b", "shared"])

    met = rows.mapInArrow(deal, PACKED).repartitionById(parts, F.col("place")).mapInArrow(meet, "key_a long, key_b long, size_a long, size_b long, shared long")
    candidates = cut(enough_shared(met, t))
    wanted = spark.sparkContext.broadcast(key_filter(candidates))

    # Texts go to the place of their key; from there to the places of their partners.
    def send_texts(batches):
        for b in batches:
            seen = {}
            for x in b.column(0).to_pylist():
                if x and len(x) >= 2 * least_words - 1 and len(words := tokens(x)) >= least_words:
                    key = text_key(words)
                    if wanted.value[key & (len(wanted.value) - 1)]:
                        seen.setdefault(key, " ".join(words))
            keys = np.array(list(seen), np.int64)
            texts, place = list(seen.items()), _place(keys, parts)
            yield _packed([(p, 0, _pack([texts[i] for i in np.flatnonzero(place == p)])) for p in np.unique(place).tolist()])

    def send_pairs(batches):
        for b in batches:
            a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            both = np.concatenate([np.stack([a, a], 1), np.stack([a, c], 1)])  # (whose place asks, for which text)
            pa_, pc = _place(both[:, 0], parts), _place(both[:, 1], parts)
            asks = np.unique(np.stack([pc, pa_, both[:, 1]], 1), axis=0)
            out = [(p, 1, asks[asks[:, 0] == p][:, 1:].astype("<i8").tobytes()) for p in np.unique(asks[:, 0]).tolist()]
            yield _packed(out)

    def pairs_home(batches):
        for b in batches:
            both = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1).astype("<i8")
            home = _place(both[:, 0], parts)
            yield _packed([(p, 1, both[home == p].tobytes()) for p in np.unique(home).tolist()])

    def answer(batches):
        for own in _grouped(batches).values():
            if 1 not in own or 0 not in own:
                continue
            asks = np.unique(np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in own[1]]), axis=0)
            wanted = set(asks[:, 1].tolist())
            texts: dict[int, str] = {}
            for blob in own[0]:
                texts.update((k, x) for k, x in _unpack(blob) if k in wanted)
            for to in np.unique(asks[:, 0]).tolist():
                mine = asks[asks[:, 0] == to][:, 1].tolist()
                for i in range(0, len(mine), 20_000):
                    yield _packed([(to, 0, _pack([(k, texts[k]) for k in mine[i : i + 20_000]]))])

    def verify(batches):
        for own in _grouped(batches).values():
            if 1 not in own:
                continue
            texts: dict[int, str] = {}
            for blob in own[0]:
                texts.update(_unpack(blob))
            known = dict(zip(texts, fragments(list(texts.values()), rarity.value, n)))
            out = []
            for a, b in np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in own[1]]).tolist():
                s = similar(known[a], known[b], t)
                if s is not None:
                    out.append((a, b, s))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["key_a", "key_b", "similarity"])

    asked = rows.mapInArrow(send_texts, PACKED).unionByName(candidates.mapInArrow(send_pairs, PACKED))
    texts = asked.repartitionById(parts, F.col("place")).mapInArrow(answer, PACKED)
    both = texts.unionByName(candidates.mapInArrow(pairs_home, PACKED)).repartitionById(parts, F.col("place"))
    return both.mapInArrow(verify, "key_a long, key_b long, similarity double")


def members(df: DataFrame, id_col: str, text_col: str, least_words: int = 40) -> DataFrame:
    """(key, id), each id once: which rows hold a token sequence."""

    def run(batches):
        for b in batches:
            at, keys = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                if x and len(x) >= 2 * least_words - 1 and len(words := tokens(x)) >= least_words:
                    at.append(i), keys.append(text_key(words))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], ["key", "id"])

    rows = spread(df.select(F.col(id_col).cast("string"), text_col).where(F.col(id_col).isNotNull()))
    return rows.mapInArrow(run, "key long, id string").distinct()


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, t: float, n: int = 3, least_words: int = 40) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, for every pair of ids whose texts reach the similarity t.

    Copies of a text are compared as one and expanded here, with similarity 1. Texts that are null or have fewer
    than least_words tokens are in no pair, rows with a null id neither; an id given twice counts once; an empty
    table gives no rows. The 64-bit key of a token sequence stands for the sequence.
    """
    pairs = similar_pairs(df, text_col, t, n, least_words)
    own = cut(members(df, id_col, text_col, least_words))
    a, b = own.select(F.col("key").alias("key_a"), F.col("id").alias("x")), own.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    linked = pairs.join(a, "key_a").join(b, "key_b").select("x", "y", "similarity")
    shared = own.groupBy("key").count().where("count > 1").select("key")
    copies = own.join(shared, "key", "left_semi")
    twins = copies.alias("p").join(copies.alias("q"), F.expr("p.key = q.key AND p.id < q.id")).select(F.col("p.id").alias("x"), F.col("q.id").alias("y"), F.lit(1.0).alias("similarity"))
    return linked.unionByName(twins).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, t: float, n: int = 3, least_words: int = 40) -> DataFrame:
    """(id, group_id, links): one row for each id; group_id is the least key of the token sequences that links join,
    links the number of other token sequences it is similar to. Copies share all. An id whose text is null or has
    too few words is in no group: its group_id is null and it has no links."""
    pairs = cut(similar_pairs(df, text_col, t, n, least_words).select("key_a", "key_b"))
    own = members(df, id_col, text_col, least_words)
    both = pairs.unionByName(pairs.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    links = both.groupBy(F.col("key_a").alias("key")).agg(F.count("*").alias("links"))
    roots = components(pairs, "key_a", "key_b")
    grouped = own.join(roots, "key", "left").join(links, "key", "left").select("id", F.coalesce("root", "key").alias("group_id"), "links")
    every = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).distinct()
    return every.join(grouped, "id", "left").select("id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(key, root): the least key of each connected component, by alternating large-star and small-star steps.

    Each step is a group-by and a join over the edges; lineage is cut in the shared folder each round.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        before = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ends.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        if now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0] == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("key")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
