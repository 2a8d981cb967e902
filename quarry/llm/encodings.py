"""p1: text that was read with the wrong code page.

A wrong reading is a substitution cipher: each byte shows as the letter that the wrong page has for it. Letter
pairs of each language are counted over the corpus (sentences sorted by models of clean samples, suspicious lines
left out). For every line with high characters the readings that the code pages allow are scored against the
likeliest language. Which swap a document suffers is then settled by expectation-maximisation over its source:
expectation, the weight of each swap for each document under the source's shares; maximisation, the shares. The
mapping so learnt is applied with str.translate where it is letter by letter, by decoding where it isn't.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.runtime import cut, spread
from quarry.llm import ciphers, decipher

LEAST_GAIN = 2.5
#: Nats against any swap where nothing is known of a source, and how far a source's other documents may lower them.
DOUBT = 5.5
TRUST = 0.7
#: Marks pairs with a letter that no sample has; where a single source has it, it may be its own cipher.
STRANGE = "?"
#: Share of a source's different lines with high characters that must surely suffer a swap for all lines that it betters in the
#: source to be left out of the counts.
MOST_SUSPICIOUS = 0.02


def origin(source_col: str) -> Column:
    """The host of an address, else its scheme, else nothing."""
    return F.coalesce(F.parse_url(F.col(source_col), F.lit("HOST")), F.regexp_extract(source_col, r"^(\w+:/*[^/]*)", 1), F.lit(""))


def fit_letter_pairs(docs: DataFrame, text_col: str, samples: DataFrame, sample_text: str = "text", sample_lang: str = "lang", max_samples: int = 5000, source_col: str = "source") -> ciphers.LetterPairs:
    """Letter pairs of each language over all texts; alphabet and so the tables are of bounded size."""
    spark = docs.sparkSession
    source = origin(source_col) if source_col in docs.columns else F.lit("")
    rows = docs.select(source.alias("source"), F.col(text_col).alias("text"))
    clean = samples.where(F.col(sample_text).isNotNull() & F.col(sample_lang).isNotNull()).select(sample_text, sample_lang, F.xxhash64(sample_text).alias("h"))
    clean = [(r[0], r[1]) for r in clean.orderBy("h").limit(max_samples).collect()]

    if not clean:
        raise ValueError("labelled samples are needed")

    def letters(batches):
        n: Counter = Counter()
        for b in batches:
            points = np.frombuffer("".join(x for x in b.column(0).to_pylist() if x).encode("utf-32-le", "surrogatepass"), "<u4")
            times = np.bincount(points)
            for p in np.flatnonzero(times).tolist():
                n.update({c: int(times[p]) for c in chr(p).lower()})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["c", "n"])

    seen = rows.select("text").mapInArrow(letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(ciphers.ALPHABET).collect()
    alphabet = [r.c for r in seen if r.c and not r.c.isdigit()] + ["0"]
    languages = sorted({lang for _, lang in clean})
    size = len(alphabet) + ciphers.OTHER
    counts = np.zeros((len(languages), size, size), np.int64)
    encode = ciphers.LetterPairs(alphabet, languages, np.zeros((len(languages), size, size), np.int64)).encode
    for text, lang in clean:
        for line in text.split("\n"):
            c = encode(line)
            np.add.at(counts[languages.index(lang)], (c[:-1], c[1:]), 1)
    first = spark.sparkContext.broadcast(ciphers.LetterPairs(alphabet, languages, counts))

    # Pairs with letters that no sample has count if several sources have them.
    # Pairs of suspicious lines are kept apart by source and swap until it is known how many lines of the source
    # suffer it: foreign names and quoted signs turn up everywhere, a swap fills its source.
    def pairs(batches):
        model, plain, kept, lines = first.value, np.zeros(counts.shape, np.int64), {}, Counter()
        for b in batches:
            clean, high, seen = [], [], set()
            for source, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for line in set((x or "").split("\n")):
                    if line.isascii():
                        clean.append((source, line))
                    elif not ciphers.disguised(line):
                        high.append((source, line))
            for part in ciphers.stretches(high, text=lambda x: x[1]):
                for doubt, (source, line) in zip(model.doubtful([x for _, x in part])[0].tolist(), part):
                    swap, sure = ciphers.suspicion(model, line, LEAST_GAIN) if doubt else (None, False)
                    if (source, line) not in seen:
                        seen.add((source, line))
                        lines[source, swap if sure else None] += 1
                    if swap is None:
                        clean.append((source, line))
                    else:
                        c = model.encode(line).astype(np.int64)
                        lang = int(model.logp[c[:-1], c[1:]].sum(0).argmax())
                        own = np.ravel_multi_index((lang, c[:-1], c[1:]), counts.shape)
                        kept.setdefault((source, swap), Counter()).update(own.tolist())
            for part in ciphers.stretches(clean, text=lambda x: x[1]):
                for i, cell, letter in zip(*(v.tolist() for v in model.count([x for _, x in part], plain))):
                    kept.setdefault((part[i][0], f"{STRANGE}{letter}"), Counter())[cell] += 1
        flat = plain.ravel()
        at = np.flatnonzero(flat)
        rows = [(s, w, -1, n) for (s, w), n in lines.items()]
        rows += [(s, w, k, n) for (s, w), cells in kept.items() for k, n in cells.items()]
        source, swap, cell, n = map(list, zip(*rows)) if rows else ([], [], [], [])
        nothing = [None] * len(at)
        columns = [pa.array(source + nothing, pa.string()), pa.array(swap + nothing, pa.string()), pa.array(np.concatenate([np.array(cell, np.int64), at])), pa.array(np.concatenate([np.array(n, np.int64), flat[at]]))]
        yield pa.RecordBatch.from_arrays(columns, ["source", "swap", "cell", "n"])

    found = cut(rows.mapInArrow(pairs, "source string, swap string, cell long, n long").groupBy("source", "swap", "cell").agg(F.sum("n").alias("n")))
    lines = found.where("cell < 0").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    bad = lines.where((F.col("share") >= MOST_SUSPICIOUS) & F.col("swap").isNotNull()).select("source", "swap")
    letters = found.where(F.startswith("swap", F.lit(STRANGE))).withColumn("source", F.coalesce("source", F.lit("")))
    lone = letters.groupBy("swap").agg(F.count_distinct("source").alias("sources"), F.min("source").alias("source")).where("sources = 1").select("source", "swap")
    kept = found.where("cell >= 0").join(bad.unionByName(lone), ["source", "swap"], "left_anti").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    np.add.at(counts.reshape(-1), kept.column("cell").to_numpy(), kept.column("n").to_numpy())
    return ciphers.LetterPairs(alphabet, languages, counts)


#: What a document's row may tell: the gain of a swap, damaged characters, or a run of high characters in its context.
EVIDENCE = "id string, source string, swap string, gain double, lang int, before string, run string, after string, n long"


def evidence(docs: DataFrame, id_col: str, text_col: str, source_col: str, model: ciphers.LetterPairs) -> DataFrame:
    """EVIDENCE: for each document the summed gains of each swap over its lines; a row with neither swap nor run if
    it holds damaged characters; and how often each run of high characters stands in its doubtful lines."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            out: list[tuple] = []
            lines = []
            for i, x in enumerate(b.column(2).to_pylist()):
                if x:
                    lines += [(i, line) for line in x.split("\n") if not line.isascii()]
                    if ciphers.damaged(x):
                        out.append((i, None, 0.0, None, None, None, None, None))
            sums: dict[tuple, float] = {}
            runs: Counter = Counter()
            for part in ciphers.stretches(lines, text=lambda x: x[1]):
                doubtful, best = model.doubtful([line for _, line in part])
                for k in np.flatnonzero(doubtful).tolist():
                    i, line = part[k]
                    for s, g in ciphers.best_reading(model, line, LEAST_GAIN):
                        sums[i, s] = sums.get((i, s), 0.0) + g
                    padded = f" {line} "
                    runs.update((i, int(best[k]), padded[m.start() - 1], m[0], padded[m.end()]) for m in ciphers.HIGH.finditer(padded))
            out += [(i, s, g, None, None, None, None, None) for (i, s), g in sums.items()]
            out += [(i, None, None, *context, n) for (i, *context), n in runs.items()]
            at, swap, gain, lang, before, text, after, n = map(list, zip(*out)) if out else ([] for _ in range(8))
            take = pa.array(at, pa.int64())
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = [b.column(0).take(take), b.column(1).take(take), *(pa.array(v, t) for v, t in zip((swap, gain, lang, before, text, after, n), kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "source", "swap", "gain", "lang", "before", "run", "after", "n"])

    once = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), origin(source_col).alias("source"), F.col(text_col).alias("text"))
    return spread(once).mapInArrow(run, EVIDENCE).distinct()


def settle(swaps: DataFrame, most_rounds: int = 8, settled: float = 0.002) -> DataFrame:
    """(id, source, swap, gain, share, w): the weight of each swap for each document, by expectation-maximisation
    over the sources' shares of swaps until their sum moves by less than a document and the part `settled`."""
    now, before = swaps.select("id", "source", "swap", "gain", F.lit(0.0).alias("share")), None
    for _ in range(most_rounds):
        x = F.exp(F.least(F.col("gain"), F.lit(60.0)) + F.col("share") - DOUBT)
        weight = now.withColumn("x", x)
        total = weight.groupBy("id").agg(F.sum("x").alias("total"))
        weight = weight.join(total, "id").select("id", "source", "swap", "gain", (F.col("x") / (1 + F.col("total"))).alias("w"))
        shares = weight.groupBy("source", "swap").agg(F.sum("w").alias("docs"))
        share = F.least(F.lit(TRUST), F.log1p(F.greatest(F.col("docs") - F.col("w"), F.lit(0.0))))
        now = cut(weight.join(shares, ["source", "swap"]).select("id", "source", "swap", "gain", share.alias("share"), "w"))
        moved = now.agg(F.sum("w"), F.sum("share")).collect()[0]
        if before is not None and all(abs((a or 0.0) - (b or 0.0)) < 1 + settled * abs(a or 0.0) for a, b in zip(moved, before)):
            break
        before = moved
    return now


def verdicts(settled: DataFrame, hurt: DataFrame) -> DataFrame:
    """(id, source, swap, swaps, gain, damaged): the affected documents, the likeliest swap of each (null if none
    is) and all that pass, the likeliest first."""
    # Equal readings: the commoner page, as listed.
    page = F.coalesce(F.array_position(F.array(*map(F.lit, ciphers.READ_AS)), F.split("swap", ">")[0]), F.lit(0))
    order = F.struct((-F.round(F.col("gain") + F.col("share"), 3)).alias("a"), page.alias("b"), F.col("swap"), F.col("gain"), F.col("source"))
    best = settled.where(F.col("gain") + F.col("share") >= DOUBT).groupBy("id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    best = best.select("id", F.col("all")[0]["source"].alias("source"), F.col("all")[0]["swap"].alias("swap"), F.col("all")["swap"].alias("swaps"), F.col("all")[0]["gain"].alias("gain"))
    return best.join(hurt.select("id", F.lit(True).alias("damaged")).distinct(), "id", "full_outer").withColumn("damaged", F.coalesce("damaged", F.lit(False)))


def wrong_readings(docs: DataFrame, id_col: str, text_col: str, source_col: str, model: ciphers.LetterPairs) -> tuple[DataFrame, DataFrame]:
    """(id, source, swap, swaps, gain, damaged), one row for each document of which some part was read wrongly, and
    the tables(source, swap, letters) by which the sources' swaps are undone.

    First the gains of the code pages' own tables settle which swaps a source's documents suffer. Under these, and
    for documents that no page explains, the sources' tables are learnt; the gains under them decide.
    damaged: characters are lost for good (replacement characters, question marks in letters' places) or left as
    controls. An id delivered twice counts once; null and empty texts and null ids give no rows.
    """
    found = cut(evidence(docs, id_col, text_col, source_col, model))
    swaps, runs = found.where("swap IS NOT NULL"), found.where("run IS NOT NULL")
    first = settle(swaps)
    tables, gains = decipher.learn(first, runs.select("id", "source", "lang", "before", "run", "after", "n"), model)
    better = swaps.select("id", "source", "swap", "gain").unionByName(gains).groupBy("id", "source", "swap").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= LEAST_GAIN)
    return verdicts(settle(better), found.where("swap IS NULL AND run IS NULL")), tables


def restore_line(model: ciphers.LetterPairs, line: str, tables: list[tuple[str, dict[str, str]]], steps: int = 3) -> str:
    """The line under the swap that makes it likeliest, as often as one does (a text may have been read wrongly
    twice). Tables are (swap, letters); multi-byte swaps are decoded where letters have nothing to say."""
    for _ in range(steps):
        if line.isascii():
            break
        best, top = line, model.score(line).max()
        for swap, letters in tables:
            table = ciphers.translation(swap, ciphers.HIGH.findall(line), letters)
            new = line.translate(table) if table is not None else ciphers.line_reading(line, swap)
            if new != line and (score := model.score(new).max()) > top:
                best, top = new, score
        if best == line:
            break
        line = best
    return line


def restored(docs: DataFrame, id_col: str, text_col: str, wrong: DataFrame, tables: DataFrame, model: ciphers.LetterPairs) -> DataFrame:
    """(id, swap, restorable, content) of the affected documents, each once; each line is read under the best of
    the document's swaps; restorable: nothing is lost."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    once = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    per = wrong.select("id", "source", F.explode("swaps").alias("s")).join(tables.withColumnRenamed("swap", "s"), ["source", "s"], "left")
    known = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("s", F.coalesce("letters", F.create_map().cast("map<string,string>"))))).alias("letters"))
    rows = once.join(wrong.select("id", "swap", "swaps"), "id").join(known, "id", "left").dropDuplicates(["id"]).select("id", "swap", "text", "swaps", "letters")

    def run(batches):
        for b in batches:
            texts, ok = [], []
            for x, swaps, letters in zip(*(b.column(c).to_pylist() for c in ("text", "swaps", "letters"))):
                learnt = {s: dict(pairs) for s, pairs in letters or []}
                own = [(s, learnt.get(s, {})) for s in swaps or []]
                y = "\n".join(restore_line(shared.value, line, own) for line in x.split("\n")) if own else x
                texts.append(y)
                ok.append(not ciphers.damaged(y))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_()), pa.array(texts, pa.string())], ["id", "swap", "restorable", "content"])

    return rows.mapInArrow(run, "id string, swap string, restorable boolean, content string")
