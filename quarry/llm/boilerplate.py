"""p3: the article of a crawled page without the lines of the site around it.

Each page is streamed through the standard library's HTML parser for the text-to-tag ratio of its lines (links and
separators of plain-text pages count as tags). The ratio alone can't tell a menu word from a list item, so it is
one feature of a line model that weighs what pages have against what clean shared files have. Its log-odds are
smoothed by a Gaussian where they are unsure, and a two-means threshold within fixed limits parts the lines.
Bare fragments, headings or teasers by their words alone, are settled by the content regions around them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.runtime import cores, spread
from quarry.llm import pagelines as pl

LOW, HIGH, SIGMA = 3.0, 4.0, 1.0


def line_features(content: str, source: str | None, title: str | None) -> tuple[list[int], list[list[int]]]:
    """Numbers and features of the non-blank lines."""
    site, lines = pl.site_name(source), content.split("\n")
    ratio = pl.text_to_tag(content)
    numbers = [i for i, line in enumerate(lines) if line.strip()]
    return numbers, [pl.features(lines[i], ratio[i], site, title or "") for i in numbers]


def is_page(source: str | None) -> bool:
    return bool(source) and source.startswith("https:")


def fit_line_model(docs: DataFrame, id_col: str, text_col: str, source_col: str, title_col: str, max_docs: int = 6000) -> pl.LineModel:
    """Line model of at most max_docs documents, those with the least hashes of their ids; their features are made
    by the executors."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\S"))
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.xxhash64(text_col).alias("g"), F.col(text_col).alias("x"), F.col(source_col).alias("s"), F.col(title_col).alias("t"))
    # A little more than is wanted passes by its hash; of that the least, so that the choice hangs on no order of rows.
    share = min(1.0, 1.2 * max_docs / max(docs.count(), 1)) * 2.0**63
    picked = rows.where(F.col("h").bitwiseAND(F.lit((1 << 63) - 1)).cast("double") <= share).orderBy("h", "g").limit(max_docs)

    def features(batches):
        for b in batches:
            out = [[sorted(f) for f in line_features(x, s, t)[1]] for x, s, t in zip(*(b.column(c).to_pylist() for c in ("x", "s", "t")))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g"), pa.array([is_page(s) for s in b.column("s").to_pylist()]), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["h", "g", "page", "lines"])

    found = picked.repartition(cores(docs.sparkSession)).mapInArrow(features, "h long, g long, page boolean, lines array<array<int>>").toArrow().sort_by([("h", "ascending"), ("g", "ascending")])
    docs_of = {True: [], False: []}
    for page, lines in zip(found.column("page").to_pylist(), found.column("lines").to_pylist()):
        docs_of[page].append(lines)
    if not docs_of[True] or not docs_of[False]:
        return pl.LineModel(np.zeros(1 << pl.BITS), 0.0)
    return pl.train(docs_of[True], docs_of[False])


def smooth(scores: np.ndarray) -> np.ndarray:
    """Gaussian average over neighbouring lines."""
    if len(scores) < 2:
        return scores
    k = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
    x = np.clip(scores, -6, 8)
    return np.convolve(x, k)[3 : 3 + len(x)] / np.convolve(np.ones(len(x)), k)[3 : 3 + len(x)]


def two_means(x: np.ndarray) -> float:
    """Midpoint between the means of the low and the high cluster."""
    a, b = float(x.min()), float(x.max())
    for _ in range(8):
        mid = (a + b) / 2
        low, high = x[x <= mid], x[x > mid]
        if not len(low) or not len(high):
            break
        a, b = float(low.mean()), float(high.mean())
    return (a + b) / 2


def site_lines(model: pl.LineModel, content: str, source: str | None, title: str | None) -> list[int]:
    """Numbers of the non-blank lines that aren't the article's."""
    whole = content.split("\n")
    numbers = [i for i, line in enumerate(whole) if line.strip()]
    if not numbers:
        return []
    lines = [whole[i].strip() for i in numbers]
    ratio = pl.text_to_tag(content)
    score = model.line_scores([whole[i] for i in numbers], [ratio[i] for i in numbers], pl.site_name(source), title or "")
    # Languages that sites use more than shared files do lift all lines of a page: its plain sentences show by how much.
    name = pl.site_name(source)
    plain = np.array([len(x) >= 40 and bool(pl.END.search(x)) and not pl.LINK.search(x) and not pl.SEPARATOR.search(x) and pl.SITE not in pl.masked(x, name) for x in lines])
    plain &= score < 6.5
    if plain.any():
        score = score - np.clip(np.median(score[plain]) - 0.5, 0.0, 3.0)
    unsure = (score > LOW - 1) & (score < HIGH + 0.5)
    value = np.where(unsure, 0.5 * score + 0.5 * smooth(score), score)
    site = value > np.clip(two_means(np.clip(value, -2, 8)), LOW, HIGH)
    name = (title or "").strip().lower()
    is_title = [bool(name) and pl.HEADING.sub("", x).strip().lower() == name for x in lines]
    site &= ~np.array(is_title)
    hashed = any(pl.HEADING.match(x) for x in lines)
    fragment = np.array([is_fragment(x) for x in lines]) & ~np.array(is_title) & (score > -1.5)
    fragment &= ~site | (score < HIGH + 1)
    i, n = 0, len(lines)
    while i < n:
        if not fragment[i]:
            i += 1
            continue
        j = i
        while j < n and fragment[j]:
            j += 1
        before, after = i > 0 and not site[i - 1], j < n and not site[j]
        site[i:j] = True
        # The last of a run heads the text that follows; on pages that mark headings it must also follow text.
        if after and (before if hashed else True) and score[j - 1] < HIGH + 0.5:
            site[j - 1] = False
        if before and after and hashed:
            site[i:j] = score[i:j] > HIGH
        i = j
    return [k for k, s in zip(numbers, site) if s]


def is_fragment(line: str) -> bool:
    """A few words without end, mark or separator, that aren't code."""
    if pl.HEADING.match(line) or pl.BULLET.match(line) or pl.TABLE.match(line) or pl.LINK.search(line) or line.startswith(">"):
        return False
    return len(line) < 70 and not pl.END.search(line) and not pl.SEPARATOR.search(line) and " --" not in line and ": " not in line[:40] and line.count("|") == 0


def boilerplate_lines(docs: DataFrame, id_col: str, text_col: str, source_col: str, title_col: str, model: pl.LineModel) -> DataFrame:
    """(id_col, line_no) of the non-blank lines of crawled pages that don't belong to the article, counted from 0
    in the content split at newlines. One pass without a shuffle but for ids delivered twice, which count once.
    Documents that aren't pages, null and empty contents have none; a null title is no title."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.where(F.col(source_col).startswith("https:") & F.col(text_col).isNotNull()).select(id_col, text_col, source_col, title_col)

    def run(batches):
        for b in batches:
            at, number = [], []
            for i, (x, s, t) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                own = site_lines(shared.value, x, s, t)
                at += [i] * len(own)
                number += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32())], [id_col, "line_no"])

    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, line_no int").distinct()


def main_content(docs: DataFrame, id_col: str, text_col: str, source_col: str, title_col: str, model: pl.LineModel) -> DataFrame:
    """(id_col, content): each crawled page once, its article's lines alone; empty if it has none."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.where(F.col(source_col).startswith("https:") & F.col(text_col).isNotNull()).select(id_col, text_col, source_col, title_col)

    def run(batches):
        for b in batches:
            out = []
            for x, s, t in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                drop = set(site_lines(shared.value, x, s, t))
                out.append("\n".join(line for k, line in enumerate(x.split("\n")) if k not in drop).strip("\n"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id_col, "content"])

    return spread(rows.dropDuplicates([id_col])).mapInArrow(run, f"`{id_col}` {kind}, content string")
