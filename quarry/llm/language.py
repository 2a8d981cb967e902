"""p8: language of every document and of every line in another language."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.runtime import spread
from quarry.llm import langmodel

#: Usual spellings of the languages (two-letter code: three-letter codes and English name).
SPELLINGS = {
    "en": ("eng", "english"),
    "de": ("deu", "ger", "german"),
    "fr": ("fra", "fre", "french"),
    "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"),
    "nl": ("nld", "dut", "dutch"),
    "id": ("ind", "indonesian"),
    "pl": ("pol", "polish"),
    "ru": ("rus", "russian"),
    "tr": ("tur", "turkish"),
    "ja": ("jpn", "japanese"),
}
SENTENCE_END = re.compile(r"[^\W\d_][\"'”’»“)\]]*[.!?…][\"'”’»“)\]]*(?:\s|$)|[。！？]|[^\W_][\"'”’»“)\]]*[.!?][\"'”’»“)\]]*\s*$")


def label_code(label: Column) -> Column:
    """Two-letter code of a label in any usual spelling; the bare lower-case label if it is none of them."""
    bare = F.lower(F.regexp_extract(F.trim(F.coalesce(label, F.lit(""))), r"^\s*([^-_\s]*)", 1))
    names = F.create_map(*[F.lit(x) for code, others in SPELLINGS.items() for other in others for x in (other, code)])
    return F.coalesce(F.try_element_at(names, bare), bare)


def fit_model(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", max_samples: int = 5000) -> langmodel.LanguageModel:
    """Model trained on at most max_samples labelled rows, chosen by a hash of their text;
    ValueError if these hold fewer than two languages."""
    rows = samples.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(text_col).alias("h"))
    picked = [(r.t, r.l) for r in rows.orderBy("h", "l").limit(max_samples).collect()]
    if len({lang for _, lang in picked}) < 2:
        raise ValueError("samples of at least two languages are needed")
    return langmodel.train(picked)


def _plain(line: str) -> str:
    return line if line.isascii() or unicodedata.is_normalized("NFKC", line) else unicodedata.normalize("NFKC", line)


def judge(model: langmodel.LanguageModel, texts: list[str | None], least_margin: float = 0.5):
    """For each text (main language or None, confidence, [(line, language, confidence), ...]).

    The main language is the one with the most letters, lines weighed by their confidence. A line counts as
    foreign if it holds a sentence, its confidence passes the calibrated floor and its letters are no tie.
    """
    lines, owner, number = [], [], []
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            if line and not line.isspace():
                lines.append(_plain(line))
                owner.append(i)
                number.append(k)
    n = len(model.languages)
    weight = np.zeros((len(texts), n))
    out = [(None, 0.0, []) for _ in texts]
    if not lines:
        return out
    logits, letters = model.logits(lines)
    p = model.probabilities(logits)
    best, owner_at = p.argmax(1), np.array(owner)
    np.add.at(weight, owner_at, p * letters[:, None])
    total = weight.sum(1)
    main = weight.argmax(1)
    for i in np.flatnonzero(total > 0):
        out[i] = (model.languages[main[i]], float(weight[i, main[i]] / total[i]), [])
    sure = p[np.arange(len(lines)), best]
    off = np.flatnonzero((best != main[owner_at]) & (letters > 0) & (sure >= max(model.floor, least_margin)))
    for j in off:
        if SENTENCE_END.search(lines[j]):
            out[owner[j]][2].append((number[j], model.languages[best[j]], float(sure[j])))
    return out


def assign_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, model: langmodel.LanguageModel) -> DataFrame:
    """(id_col, line_no, lang, confidence, label_right): a row with line_no -1 for each document and one for
    each line that is in another language, counted from 0 in the text split at newlines.

    One pass without a shuffle; the model's fixed-size table is broadcast. A document without words has a
    null lang, confidence 0 and a null label_right. Repeated rows give repeated results.
    """
    rows = spread(df.select(F.col(id_col), F.col(text_col), label_code(F.col(label_col)).alias("_label")))
    kind = rows.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {kind}, line_no int, lang string, confidence double, label_right boolean"

    def run(batches):
        for b in batches:
            judged = judge(shared.value, b.column(1).to_pylist())
            row, line, lang, sure, right = [], [], [], [], []
            for i, ((main, conf, others), label) in enumerate(zip(judged, b.column(2).to_pylist())):
                for k, x, c in [(-1, main, conf), *others]:
                    row.append(i), line.append(k), lang.append(x), sure.append(c)
                    right.append(None if k >= 0 or x is None else label == x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(line, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(right, pa.bool_())],
                [id_col, "line_no", "lang", "confidence", "label_right"],
            )

    return rows.mapInArrow(run, schema)


def language_cases(assigned: DataFrame, id_col: str) -> DataFrame:
    """Wrong or missing labels (line_no -1), whatever the confidence, and foreign lines."""
    wrong = (F.col("line_no") == -1) & ~F.col("label_right")
    return assigned.where(wrong | (F.col("line_no") >= 0)).select(id_col, "line_no", "lang")
