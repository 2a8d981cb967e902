"""p4: items over a size limit cut into overlapping pieces at natural boundaries.

Text is handled range by range, whether it is a row's or a file's. For each range a worker finds the natural
boundaries from the range and a halo on either side. Each range begins anew at a strongest boundary near its
start, its fence, which the halo of the range before shows as well, so ranges are cut independently of each other.
The tables of all ranges are stitched by prefix sums of their lengths and numbers of pieces, and pieces are
emitted by offset. No Python task holds more than one range with its halos; a file is never loaded whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.runtime import cores, cut, prepare

#: Boundaries in the order of their strength: blank line, line end, sentence end, white space.
BOUNDARY = re.compile(r"(?P<p>\r?\n[^\S\n]*\n\s*)|(?P<l>\r?\n[^\S\n]*)|(?P<s>(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？]))|(?P<w>\s+)")
#: White space of every Unicode kind.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STRENGTH = {"p": 4, "l": 3, "s": 2, "w": 1}
HALO = 256


def boundaries(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[int, int]]:
    """(offset, strength) of the boundaries that end in (lo, hi]; a piece may begin at the offset."""
    hi = len(text) if hi is None else hi
    a = max(0, lo - HALO)
    return [(m.end(), STRENGTH[m.lastgroup]) for m in BOUNDARY.finditer(text, a, min(len(text), hi + HALO)) if lo < m.end() <= hi]


def overlap_start(offsets: list[int], end: int, overlap: int, least: int) -> int:
    """Where the piece after one that ends at `end` begins: the first boundary within the overlap, else all of it."""
    a = max(end - overlap, least)
    i = bisect_left(offsets, a)
    return offsets[i] if i < len(offsets) and offsets[i] < end else a


def cut_points(bounds: list[tuple[int, int]], begin: int, end: int, size: int, overlap: int, fence: int | None = None) -> list[tuple[int, int]]:
    """Pieces [a, b) of at most `size` over [begin, end), each cut at the strongest boundary in the second half
    of its room (the last of these), else at the last boundary in it, else at the limit itself."""
    offsets = [o for o, _ in bounds]
    out, a = [], begin
    least = begin if fence is None else fence
    while end - a > size:
        limit = a + size
        floor = max(least, a + overlap) + 1
        i, j = bisect_left(offsets, max(floor, a + size // 2)), bisect_right(offsets, limit)
        if i < j:
            b = max(bounds[i:j], key=lambda x: (x[1], x[0]))[0]
        else:
            i = bisect_left(offsets, floor)
            b = offsets[j - 1] if i < j else limit
        out.append((a, b))
        a, least = overlap_start(offsets, b, overlap, a + 1), b
    out.append((a, end))
    return out


def fence(text: str, at: int, size: int) -> int:
    """Where the range that begins at `at` begins anew: the strongest boundary among the next `size`, the first of
    these, else `at`. Seen from the range before and from its own, with their halos, it is the same."""
    found = boundaries(text, at, min(len(text), at + size))
    return max(found, key=lambda x: (x[1], -x[0]))[0] if found else at


def cut_range(text: str, lo: int, hi: int, first: bool, last: bool, size: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of the stretch from the range's fence to the next one's; text is the range [lo, hi) with its halos."""
    start = lo if first else fence(text, lo, size)
    end = hi if last else fence(text, hi, size)
    if end <= start:
        return []
    bounds = boundaries(text, max(0, start - overlap - 1), end)
    begin = start if first else overlap_start([o for o, _ in bounds], start, overlap, max(0, start - overlap))
    return cut_points(bounds, begin, end, size, overlap, None if first else start)


def halo_of(size: int, overlap: int) -> int:
    return size + overlap + 2 * HALO


def pieces(text: str, size: int, overlap: int, width: int = 1 << 18) -> list[tuple[int, int]]:
    """Pieces of the text without white space at its ends; offsets are code points of the original text."""
    begin, body, out = len(text) - len(text.lstrip()), text.strip(), []
    halo = halo_of(size, overlap)
    for lo in range(0, len(body), width):
        a, hi = max(0, lo - halo), min(len(body), lo + width)
        out += [(begin + a + x, begin + a + y) for x, y in cut_range(body[a : hi + halo], lo - a, hi - a, lo == 0, hi == len(body), size, overlap)]
    return out


RANGES = "item_kind string, item_id string, mark long, k int, last boolean, lead long, lo int, width int, text string"
ITEM = ("item_kind", "item_id", "mark")


def oversized_ranges(df: DataFrame, id_col: str, text_col: str, limit: int, kind: str, size: int = 1000, overlap: int = 50, width: int = 1 << 18) -> DataFrame:
    """Ranges of `width` code points, with halos, of each item whose content has more than `limit` code points
    without white space (of any Unicode kind) at its ends. Null, empty and blank contents and null ids have none;
    an item given twice is met once, one given with two contents once for each (by `mark`).

    All this is done inside the JVM; the ranges of an item are dealt over the cluster.
    """
    halo, text = halo_of(size, overlap), F.col("body")
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) > limit))
    rows = rows.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("whole"), F.trim(F.col(text_col), F.lit(WHITE)).alias("body")).where(F.length("body") > limit)

    def one(k):
        lo, begin = k * width, F.greatest(k * width - halo, F.lit(0))
        own = F.least(F.lit(width), F.length(text) - lo)
        return F.struct(k.alias("k"), (lo + width >= F.length(text)).alias("last"), (lo - begin).alias("lo"), own.alias("width"), F.substring(text, begin + 1, F.lit(width + 2 * halo)).alias("text"))

    ks = F.sequence(F.lit(0), ((F.length(text) - 1) / width).cast("int"))
    lead = F.length("whole") - F.length(F.ltrim(F.col("whole"), F.lit(WHITE)))
    cuts = rows.select(F.lit(kind).alias("item_kind"), "item_id", F.xxhash64("body").alias("mark"), lead.cast("long").alias("lead"), F.explode(F.transform(ks, one)).alias("r"))
    return cuts.select("item_kind", "item_id", "mark", "lead", "r.*").dropDuplicates([*ITEM, "k"])


def cut_ranges(ranges: DataFrame, size: int = 1000, overlap: int = 50, width: int = 1 << 18, content: bool = True) -> DataFrame:
    """(item_kind, item_id, mark, k, pieces), one row for each range: its own stretch of the table of pieces, as
    offsets in the item's original text; with their contents if wanted."""
    piece = "start: bigint, stop: bigint" + (", content: string" if content else "")

    def run(batches):
        for b in batches:
            out = []
            for k, last, lo, own, lead, text in zip(*(b.column(c).to_pylist() for c in ("k", "last", "lo", "width", "lead", "text"))):
                shift = lead + k * width - lo
                found = cut_range(text, lo, lo + own, k == 0, last, size, overlap)
                out.append([{"start": shift + x, "stop": shift + y} | ({"content": text[x:y]} if content else {}) for x, y in found])
            kind = [("start", pa.int64()), ("stop", pa.int64())] + ([("content", pa.string())] if content else [])
            columns = [b.column(c) for c in (*ITEM, "k")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.struct(kind)))], [*ITEM, "k", "pieces"])

    return ranges.mapInArrow(run, f"item_kind string, item_id string, mark long, k int, pieces array<struct<{piece}>>")


def split_items(cut_table: DataFrame) -> DataFrame:
    """(item_kind, item_id, piece_no, start, stop, content) from the ranges' tables, numbered by prefix sums.

    Pieces have at most `size` code points; each begins at most `overlap` before the end of the one before:
    exactly there, or at the first boundary after that. Without their overlaps they make up the stripped text.
    """
    before = F.sum(F.size("pieces")).over(Window.partitionBy(*ITEM).orderBy("k")) - F.size("pieces")
    rows = cut_table.withColumn("before", before)
    return rows.select("item_kind", "item_id", "before", F.posexplode("pieces").alias("i", "p")).select("item_kind", "item_id", (F.col("before") + F.col("i")).cast("int").alias("piece_no"), "p.*")


def running_totals(df: DataFrame, rows: int, key: str, values: list[str], block: int = 4096) -> DataFrame:
    """df with `<value>_before`, the sum of each value over all smaller keys (0, 1, ...), level by level: sums
    within blocks of keys, plus the running totals of the blocks' sums. No task sorts more than a block."""
    name = f"_{key}"
    number = F.floor(F.col(key) / block)
    inside = Window.partitionBy(name).orderBy(key)
    own = df.withColumn(name, number).select("*", *[(F.sum(v).over(inside) - F.col(v)).alias(f"{v}_before") for v in values])
    if rows <= block:
        return own.drop(name)
    sums = df.groupBy(number.alias(name)).agg(*[F.sum(v).alias(v) for v in values])
    above = running_totals(sums, -(-rows // block), name, values, block).select(name, *[F.col(f"{v}_before").alias(f"_{v}") for v in values])
    joined = own.join(above, name)
    return joined.select(*df.columns, *[(F.col(f"{v}_before") + F.col(f"_{v}")).alias(f"{v}_before") for v in values])


# ---- one giant file


def _open(path: str):
    """Path on a mounted file system, or any URI that Arrow's file systems know."""
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
    else:
        system, inner = fs.LocalFileSystem(), path
    return system, inner


def _read(path: str, lo: int, hi: int) -> bytes:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return f.read_at(max(0, hi - lo), lo)


def _whole_chars(data: bytes) -> int:
    """Bytes at the start that continue a character begun before."""
    n = 0
    while n < min(4, len(data)) and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def _range_text(path: str, lo: int, hi: int, halo: int) -> tuple[str, int, int]:
    """Text of the range with halos, and the range's own first and last offset (in characters) in it. A
    character belongs to the range in which it begins."""
    a = max(0, lo - halo)
    data = _read(path, a, hi + halo)
    skip = _whole_chars(data) if a else 0
    split = [lo - a, min(hi - a, len(data))]
    split = [s + _whole_chars(data[s : s + 4]) for s in split]
    head, body, tail = data[skip : split[0]], data[split[0] : split[1]], data[split[1] :]
    texts = [x.decode("utf-8", "replace") for x in (head, body)] + [tail.decode("utf-8", "ignore")]
    return "".join(texts), len(texts[0]), len(texts[0]) + len(texts[1])


def split_file(spark: SparkSession, path: str, size: int = 1000, overlap: int = 50, range_bytes: int = 8 << 20) -> DataFrame:
    """(piece_no, start, stop, content) of one UTF-8 file of any size; offsets are code points of the file.

    Two passes over the byte ranges: the first counts each range's characters and pieces; running totals over that
    small table (one row a range) give where each range begins; the second emits the pieces by offset.
    """
    prepare(spark)
    system, inner = _open(path)
    total = system.get_file_info(inner).size
    n = max(1, -(-total // range_bytes))
    halo = 4 * halo_of(size, overlap)

    def one(k: int):
        text, lo, hi = _range_text(path, k * range_bytes, min(total, (k + 1) * range_bytes), halo)
        return text, lo, hi, cut_range(text, lo, hi, k == 0, k == n - 1, size, overlap)

    def survey(batches):
        for b in batches:
            out = [(k, hi - lo, len(cuts)) for k in b.column(0).to_pylist() for _, lo, hi, cuts in [one(k)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["k", "chars", "n"])

    table = cut(spark.range(0, n, 1, min(n, 4 * cores(spark))).mapInArrow(survey, "k long, chars long, n long"))

    def emit(batches):
        for b in batches:
            for k, base, number in zip(*(b.column(c).to_pylist() for c in ("k", "chars_before", "n_before"))):
                text, lo, _, cuts = one(k)
                starts = np.array([a for a, _ in cuts], np.int64)
                stops = np.array([e for _, e in cuts], np.int64)
                columns = [pa.array(number + np.arange(len(cuts))), pa.array(base + starts - lo), pa.array(base + stops - lo), pa.array([text[a:e] for a, e in cuts], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["piece_no", "start", "stop", "content"])

    plan = running_totals(table, n, "k", ["chars", "n"]).repartition(min(n, 4 * cores(spark)), "k")
    return plan.mapInArrow(emit, "piece_no long, start long, stop long, content string")
