"""Substitution tables of sources, learnt by expectation-maximisation against letter pairs.

A source's swap is a channel: each letter that was meant shows as one symbol. Expectation: for each run of symbols
in its context, forward and backward over its letters, how likely each letter is in each place, given the channel so
far and the language's letter pairs. Maximisation: these expected counts, summed over the source by a group-by, with
the code pages' own table (or, for a swap that no page explains, all high letters of the language alike) as the
prior. All state is a small table of counts for each source and swap; runs are met in Arrow batches wherever they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.runtime import cut
from quarry.llm import ciphers

#: Weight of the prior against one expected occurrence: a page's table is trusted more than an even guess.
PAGE_TRUST, EVEN_TRUST = 8.0, 0.5
#: High letters of a language that an unknown symbol may stand for.
CANDIDATES = 32
#: Letters less likely than this for a symbol aren't followed up.
FAINT = 0.003
#: A table that no page explains must gain this much over its source, and so much more for each of its letters; and a
#: document this much.
LEAST_TABLE, LEAST_LETTER, LEAST_DOCUMENT = 30.0, 5.0, 12.0
#: Documents of a source that such a table must better.
LEAST_DOCUMENTS = 3
#: Runs of a source and swap that are met in one go.
BLOCK = 5000


class Channel:
    """One source's swap: what each symbol may stand for."""

    def __init__(self, model: ciphers.LetterPairs, swap: str, masses: list[tuple[str, str, float]]):
        self.model, self.swap, self.known = model, swap, {}
        self.mass: dict[str, dict[str, float]] = {}
        for symbol, letter, n in masses:
            self.mass.setdefault(symbol, {})[letter] = n

    def prior(self, symbol: str, lang: int) -> dict[str, float]:
        own, high = symbol.lower(), self.model.high_letters(lang, CANDIDATES)
        page = "" if self.swap == ciphers.LEARNT else (ciphers.readings(symbol).get(self.swap) or "").lower()
        out = dict.fromkeys(high[:12] if len(page) == 1 else high, (0.1 if len(page) == 1 else 0.7) / max(len(high), 1))
        out[own] = out.get(own, 0.0) + (0.05 if len(page) == 1 else 0.3)
        if len(page) == 1:
            out[page] = out.get(page, 0.0) + 0.85
        return out

    def letters(self, symbol: str, lang: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Letters the symbol may stand for, their codes, and their probabilities."""
        key = (symbol, lang)
        if key not in self.known:
            prior, seen = self.prior(symbol, lang), self.mass.get(symbol, {})
            trust = EVEN_TRUST if self.swap == ciphers.LEARNT else PAGE_TRUST
            names = list(prior | seen)
            p = np.array([trust * prior.get(x, 0.0) + seen.get(x, 0.0) for x in names])
            p /= p.sum()
            held = np.flatnonzero(p >= FAINT)
            names = [names[k] for k in held.tolist()]
            self.known[key] = names, self.model.codes(names), p[held] / p[held].sum()
        return self.known[key]

    def expect(self, lang: int, before: str, run: str, after: str) -> tuple[list[tuple[str, list[str], np.ndarray]], float]:
        """For each symbol of the run its letters and their probabilities in this place, and the run's log-likelihood."""
        states = [self.letters(ch, lang) for ch in run]
        left, right = self.model.codes([before.lower()[0], after.lower()[0]])
        pair = self.model.pair_chances(lang)
        ahead, total = [], 0.0
        for i, (_, codes, p) in enumerate(states):
            into = pair[left, codes] if i == 0 else ahead[-1] @ pair[states[i - 1][1][:, None], codes]
            a = into * p
            total += float(np.log(a.sum()))
            ahead.append(a / a.sum())
        back = pair[states[-1][1], right]
        out = []
        for i in range(len(states) - 1, -1, -1):
            names, codes, p = states[i]
            both = ahead[i] * back
            out.append((run[i], names, both / both.sum()))
            if i:
                back = pair[states[i - 1][1][:, None], codes] @ (p * back)
                back /= back.sum()
        return out[::-1], total


SCHEMA = "source string, swap string, symbol string, letter string, mass double"


def learn(settled: DataFrame, runs: DataFrame, model: ciphers.LetterPairs, most_rounds: int = 6, gained: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """tables(source, swap, letters map) and gains(id, source, swap, gain), which are to be added to the pages' own.

    settled: weights of the swaps for each document, of which the single-byte ones are learnt; runs: EVIDENCE's runs of all doubtful documents.
    Documents that no swap explains are taken under the swap "learnt" of their source.
    """
    shared = runs.sparkSession.sparkContext.broadcast(model)
    # Equal readings share a document's weight; one of them, the same for all its source's documents, carries it.
    first = F.max_by(F.col("swap"), F.struct(F.round("w", 4), "swap"))
    weights = settled.groupBy("id").agg(first.alias("swap"), F.sum("w").alias("w")).where("w >= 0.5")
    explained = weights.select("id", F.col("w").alias("all"))
    # Signs that stand alone are no letters.
    beside = F.concat("before", "run", "after").rlike(r"\p{L}")
    runs = runs.where(beside)
    alone = runs.select("id").distinct().join(explained, "id", "left").where("all IS NULL").select("id", F.lit(ciphers.LEARNT).alias("swap"), F.lit(1.0).alias("w"))
    taken = weights.where(~F.exists(F.split("swap", ">"), lambda p: p.isin(*ciphers.WIDE))).unionByName(alone)
    own = cut(runs.join(taken, "id"))
    merged = own.groupBy("source", "swap", "lang", "before", "run", "after").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    # The runs of one source and swap are met in blocks, each beside the source's table.
    sizes = merged.groupBy("source", "swap").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    merged = cut(merged.join(sizes, ["source", "swap"]).withColumn("block", F.pmod(F.hash("run"), "blocks")).drop("blocks"))
    places = cut(merged.select("source", "swap", "block").distinct())
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("symbol", "string"), ("letter", "string"), ("mass", "double"))]
    runs_only = merged.select("source", "swap", "block", "lang", "before", "run", "after", "n", *nothing)

    def expectation(key, table):
        source, swap, _ = (k.as_py() for k in key)
        known = table.filter(pc.is_valid(table.column("symbol")))
        channel = Channel(shared.value, swap, list(zip(*(known.column(c).to_pylist() for c in ("symbol", "letter", "mass")))))
        sums: dict[tuple[str, str], float] = {}
        for lang, before, run, after, n in zip(*(table.filter(pc.is_valid(table.column("run"))).column(c).to_pylist() for c in ("lang", "before", "run", "after", "n"))):
            places, likely = channel.expect(lang, before, run, after)
            sums["", ""] = sums.get(("", ""), 0.0) + n * likely
            for symbol, names, p in places:
                for k in np.flatnonzero(p > 0.01).tolist():
                    sums[symbol, names[k]] = sums.get((symbol, names[k]), 0.0) + n * float(p[k])
        symbol, letter = zip(*sums) if sums else ((), ())
        columns = [pa.array([source] * len(sums), pa.string()), pa.array([swap] * len(sums), pa.string()), pa.array(symbol, pa.string()), pa.array(letter, pa.string()), pa.array(list(sums.values()), pa.float64())]
        return pa.table(columns, ["source", "swap", "symbol", "letter", "mass"])

    masses, before = None, None
    for _ in range(most_rounds):
        rows = runs_only
        if masses is not None:
            blank = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "int"), ("before", "string"), ("run", "string"), ("after", "string"), ("n", "double"))]
            rows = rows.unionByName(masses.where("symbol <> ''").join(places, ["source", "swap"]).select("source", "swap", "block", *blank, "symbol", "letter", "mass"))
        masses = cut(rows.groupBy("source", "swap", "block").applyInArrow(expectation, SCHEMA).groupBy("source", "swap", "symbol", "letter").agg(F.sum("mass").alias("mass")))
        likely = masses.where("symbol = ''").agg(F.sum("mass")).collect()[0][0] or 0.0
        if before is not None and likely - before <= gained * abs(likely):
            break
        before = likely
    # A cipher shows each letter as one symbol: of several with the same letter the most frequent keeps it.
    shown = masses.where("symbol <> ''").groupBy("source", "swap", "symbol").agg(F.sum("mass").alias("all"), F.max_by(F.struct("letter", "mass"), F.struct("mass", "letter")).alias("b"))
    shown = shown.select("source", "swap", "symbol", "all", "b.*").where("mass >= 0.5 * all AND mass >= 0.5")
    small = F.lower("symbol") == F.col("symbol")
    first = F.row_number().over(Window.partitionBy("source", "swap", "letter", small).orderBy(F.desc("mass"), "symbol"))
    sure = shown.withColumn("first", first).where((F.col("first") == 1) & (F.col("letter") != F.lower("symbol")))
    # Small letters were learnt; a symbol that is itself a capital shows one.
    letter = F.when(F.upper("symbol") == F.lower("symbol"), F.col("letter")).when(F.col("symbol") == F.upper("symbol"), F.upper("letter")).otherwise(F.col("letter"))
    tables = sure.groupBy("source", "swap").agg(F.map_from_entries(F.collect_list(F.struct("symbol", letter))).alias("letters"))

    def unlike_page(batches):
        for b in batches:
            kept = [{k: v for k, v in m if swap == ciphers.LEARNT or ciphers.readings(k).get(swap) != v} for swap, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(m.items()) for m in kept], pa.map_(pa.string(), pa.string()))], ["source", "swap", "letters"])

    # What the pages' tables say as well needn't be said again.
    tables = cut(tables.mapInArrow(unlike_page, "source string, swap string, letters map<string,string>").where(F.size("letters") > 0))

    def gain(batches):
        for b in batches:
            model, out = shared.value, []
            for swap, lang, before, run, after, n, letters in zip(*(b.column(c).to_pylist() for c in ("swap", "lang", "before", "run", "after", "n", "letters"))):
                table = dict(letters)
                page = run if swap == ciphers.LEARNT else ciphers.line_reading(run, swap)
                new = "".join(table.get(ch, p) for ch, p in zip(run, page)) if len(page) == len(run) else page
                diff = 0.0 if new.lower() == page.lower() else float(model.local(before + new + after)[lang] - model.local(before + page + after)[lang])
                out.append(n * diff)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), b.column("swap"), pa.array(out, pa.float64()), pa.array([len(x) for x in b.column("letters").to_pylist()], pa.int32())], ["id", "source", "swap", "gain", "size"])

    touched = F.exists(F.split("run", ""), lambda x: F.map_contains_key("letters", x))
    diffs = own.join(tables, ["source", "swap"]).where(touched).mapInArrow(gain, "id string, source string, swap string, gain double, size int")
    per = cut(diffs.groupBy("id", "source", "swap").agg(F.sum("gain").alias("gain"), F.max("size").alias("size")))
    whole = per.where((F.col("swap") == ciphers.LEARNT) & (F.col("gain") >= LEAST_DOCUMENT)).groupBy("source").agg(F.sum("gain").alias("all"), F.max("size").alias("letters"), F.count("*").alias("docs"))
    good = whole.where((F.col("all") >= LEAST_TABLE + LEAST_LETTER * F.col("letters")) & (F.col("docs") >= LEAST_DOCUMENTS)).select("source", F.lit(ciphers.LEARNT).alias("swap"))
    new = per.where((F.col("swap") == ciphers.LEARNT) & (F.col("gain") >= LEAST_DOCUMENT)).join(good, ["source", "swap"], "left_semi")
    return tables, per.where((F.col("swap") != ciphers.LEARNT) & (F.col("gain") > 0)).unionByName(new).select("id", "source", "swap", "gain")
