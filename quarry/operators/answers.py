"""Scores of generated answers, over answers(qid, answer, retrieved, expected, out_of_scope)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

NUMBERED = r"\[(\d+)\]"
NAMED = r"(?i)\[Source:\s*([^\]]+)\]"


def citation_precision(answer: Column, sources: Column, k: int = 0) -> Column:
    """Share of citation markers that point to something retrieved: numbers within the first k (all, if k is 0),
    names among their sources. 1 without markers."""
    body = F.coalesce(answer, F.lit(""))
    pool = F.coalesce(F.slice(sources, 1, k) if k > 0 else sources, F.array().cast("array<string>"))
    numbers = F.regexp_extract_all(body, F.lit(NUMBERED), F.lit(1))
    names = F.transform(F.regexp_extract_all(body, F.lit(NAMED), F.lit(1)), lambda x: F.trim(x))
    right = F.size(F.filter(numbers, lambda x: F.coalesce(x.try_cast("bigint").between(1, F.size(pool)), F.lit(False))))
    right = right + F.size(F.filter(names, lambda x: F.coalesce(F.array_contains(pool, x), F.lit(False))))
    total = F.size(numbers) + F.size(names)
    return F.when(total > 0, right / total).otherwise(1.0)


def answer_correctness(answer: Column, expected: Column) -> Column:
    """1 without an expectation or if it is part of the answer, else the share of its tokens the answer has."""
    a, e = text.normal_answer(answer), text.normal_answer(expected)
    wanted = F.filter(F.split(e, r"\s+"), lambda x: x != "")
    have = F.filter(F.split(a, r"\s+"), lambda x: x != "")
    share = F.size(F.array_intersect(have, wanted)) / F.greatest(F.size(wanted), F.lit(1))
    return F.when(e == "", 1.0).when(F.contains(a, e), 1.0).otherwise(share)


def correctness_score(answer: Column, expected: Column) -> Column:
    """As a scorer: 1 where nothing is expected, 0 for an empty answer."""
    blank = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when(F.coalesce(expected, F.lit("")) == "", 1.0).when(blank, 0.0).otherwise(answer_correctness(answer, expected))


def judged_score(answer: Column, expected: Column, chat: Callable[[str], str] | None) -> Column:
    """The judge's number where something is expected and answered; the deterministic score where it gives none."""
    plain = correctness_score(answer, expected)
    if chat is None:
        return plain

    @F.pandas_udf("double")
    def ask(a: pd.Series, e: pd.Series) -> pd.Series:
        blank = lambda x: not (x or "").strip()
        return pd.Series([None if blank(x) or blank(y) else judged_correctness(chat, x, y) for x, y in zip(a, e)], dtype="float64")

    return F.coalesce(ask(answer, expected), plain)


def abstention(answer: Column, out_of_scope: Column) -> Column:
    """1 in scope; out of scope, whether the answer abstains."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    refuses = F.exists(text.words(*text.REFUSALS), lambda m: F.contains(low, m))
    return F.when(~F.coalesce(out_of_scope, F.lit(False)), 1.0).when(refuses, 1.0).otherwise(0.0)


CLAIMS = "List the separate factual claims of this answer as a JSON array of short strings, nothing else.\n\nAnswer:\n{answer}"
VERDICTS = "For each claim say whether the context makes it SUPPORTED, CONTRADICTED or UNSUPPORTED. Give a JSON array of these words in the claims' order, nothing else.\n\nContext:\n{context}\n\nClaims:\n{claims}"
VERDICT = "Does the context make this claim SUPPORTED, CONTRADICTED or UNSUPPORTED? Give the one word.\n\nContext:\n{context}\n\nClaim:\n{claim}"
SINGLE = "Is the answer wholly supported by the context? First line: FAITHFULNESS: <number from 0.0 to 1.0>.\n\nContext:\n{context}\n\nAnswer:\n{answer}"


def _list(raw: str) -> list[str]:
    try:
        data = json.loads(raw)
    except (TypeError, ValueError):
        return []
    return [str(x) for x in data] if isinstance(data, list) else []


def _supported(v: str) -> bool:
    up = (v or "").upper()
    return "SUPPORTED" in up and "UNSUPPORTED" not in up and "CONTRADICTED" not in up


def judge_faithfulness(chat: Callable[[str], str], answer: str, context: str, mode: str = "claims") -> float:
    """Supported claims by claims; 1 without an answer, a context or a claim; 0 if the judge fails."""
    if not (answer or "").strip() or not (context or "").strip():
        return 1.0
    try:
        if mode == "single":
            found = re.search(r"([0-9]*\.?[0-9]+)", chat(SINGLE.format(context=context, answer=answer)))
            return round(max(0.0, min(1.0, float(found[1]))), 3) if found else 0.0
        claims = [c for c in _list(chat(CLAIMS.format(answer=answer))) if c.strip()]
        if not claims:
            return 1.0
        verdicts = _list(chat(VERDICTS.format(context=context, claims=json.dumps(claims))))
        if len(verdicts) != len(claims):
            verdicts = [chat(VERDICT.format(context=context, claim=c)) for c in claims]
        return round(sum(map(_supported, verdicts)) / len(claims), 3)
    except Exception:
        return 0.0


def faithfulness(answers: DataFrame, chat: Callable[[str], str], mode: str = "claims") -> DataFrame:
    """(qid, value) of answers(qid, answer, context)."""

    @F.pandas_udf("double")
    def score(answer: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([judge_faithfulness(chat, a, c, mode) for a, c in zip(answer, context)])

    return answers.select("qid", score("answer", "context").alias("value"))


def judged_correctness(chat: Callable[[str], str] | None, answer: str, expected: str) -> float | None:
    """A judge's number, None where the deterministic score must stand in."""
    if chat is None:
        return None
    try:
        found = re.search(r"([0-9]*\.?[0-9]+)", chat(f"Do answer and reference state the same facts? First line: CORRECTNESS: <number from 0.0 to 1.0>.\n\nReference:\n{expected}\n\nAnswer:\n{answer}"))
    except Exception:
        return None
    return max(0.0, min(1.0, float(found[1]))) if found else None
