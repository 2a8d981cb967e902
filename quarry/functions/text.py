"""Text scalars as column expressions; all run inside the JVM."""

from __future__ import annotations

import logging
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

TOKEN = r"[\p{L}\p{N}_]+"
#: White space of any Unicode kind; \s alone is that of ASCII in the JVM.
WHITE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"

#: English and Indonesian function words, opt-in for lexical retrieval.
STOPWORDS = {
    "en": """a an and are as at be by for from has have in is it its of on or that the to was were will with this these
        those they them their there here which who whom whose what when where why how all any both each few more most
        other some such no nor not only own same so than too very can do does did doing would should could about into
        over under again further then once""".split(),
    "id": """yang dan di ke dari pada untuk dengan dalam atau juga karena maka jika kalau agar supaya sehingga tetapi
        tapi namun oleh ada adalah akan bisa dapat sudah telah saya aku kami kita kamu anda ia dia mereka ini itu
        tersebut satu sebuah seorang setiap beberapa banyak lebih sedikit sangat paling hanya masih belum tidak bukan
        tanpa tentang antara hingga sampai bagi sama menjadi sebagai saat ketika waktu tahun hari orang nya lah kah pun
        per para atas""".split(),
}

#: Fillers that the rule-based rewrite drops.
FILLERS = """a an the of to in on at for and or is are was were be been being do does did i you he she it we they me him
    her us them my your his its our their this that these those with from by as can could would should will shall please
    hey um like""".split()

#: Phrases by which an answer abstains.
REFUSALS = (
    "i don't know", "i do not know", "i don't have", "i do not have", "i cannot", "i can't", "i'm not sure",
    "i am not sure", "no information", "not enough information", "not enough context", "unable to answer",
    "cannot answer", "no clear answer",
)


def words(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def stopwords(spec) -> list[str] | None:
    """None or False: none; True: English; a language of STOPWORDS; any other string: none; else the own words."""
    if spec is None or spec is False:
        return None
    if spec is True:
        return STOPWORDS["en"]
    if isinstance(spec, str):
        if spec.lower() not in STOPWORDS:
            log.warning("no stopwords %r; no word is left out", spec)
        return STOPWORDS.get(spec.lower())
    return sorted({str(w).lower() for w in spec})


def stemmer(spec):
    """A function from words to stems: "id" if the Indonesian stemmer's library is installed, else None with a warning."""
    if spec is None or spec is False:
        return None
    if spec != "id":
        log.warning("no stemmer %r; words stay as they are", spec)
        return None
    try:
        from Sastrawi.Stemmer.StemmerFactory import StemmerFactory
    except ImportError:
        log.warning("stemmer 'id' needs Sastrawi; words stay as they are")
        return None
    return lru_cache(200_000)(StemmerFactory().create_stemmer().stem)


def stemmed(terms: Column, spec) -> Column:
    """Terms as the stemmer gives them, in Arrow batches; the terms themselves without one."""
    if stemmer(spec) is None:
        return terms

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        stem = stemmer(spec)
        return lists.map(lambda ws: [stem(w) for w in ws])

    return run(terms)


def tokens(text: Column, stop=None, stem=None) -> Column:
    """Lower-case runs of letters, digits and underscores, in order; null gives none. Words are left out before the
    others are stemmed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    drop = stopwords(stop)
    return stemmed(F.filter(found, lambda t: ~t.isin(drop)) if drop else found, stem)


def expand(terms: Column, synonyms: dict[str, list[str]] | None) -> Column:
    """Terms followed by the synonyms of each, verbatim; keys are matched in lower case."""
    if not synonyms:
        return terms
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k.lower()), words(*v))])
    more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), words())))
    return F.concat(terms, more)


def rewrite_rule(query: Column) -> Column:
    """Tokens without fillers; a query of nothing but fillers stays as it is."""
    kept = F.filter(tokens(query), lambda t: ~t.isin(FILLERS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.trim(F.regexp_replace(query, r"\s+", " ")))


def normal_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""))


def snippet(text: Column, n: int = 10) -> Column:
    """First n words between white space."""
    return F.array_join(F.slice(F.filter(F.split(text, f"{WHITE}+"), lambda x: x != ""), 1, n), " ")


def passage_id(text: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha1(text), 1, 12))


def is_heading(text: Column) -> Column:
    return text.rlike(r"^#{1,6}\s")


def is_binary(content: Column) -> Column:
    return F.position(F.lit(b"\x00"), F.substring(content, 1, 8192)) > 0


def clamp(x: Column) -> Column:
    """Into [0, 1]; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def sigmoid(x: Column) -> Column:
    """Logistic function without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def round3(x: Column) -> Column:
    """Half-even at three digits."""
    return F.bround(x, 3)


def first_number(text: Column) -> Column:
    """First unsigned decimal number, clamped to [0, 1]; 0 where there is none."""
    return F.coalesce(clamp(F.regexp_extract(text, r"([0-9]*\.?[0-9]+)", 1).try_cast("double")), F.lit(0.0))


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), words())


def verdict(text: Column) -> Column:
    """Negatives first, as one verdict's name is part of another's; anything else is unsupported."""
    up = F.upper(F.coalesce(text, F.lit("")))
    names = ("UNSUPPORTED", "CONTRADICTED", "SUPPORTED")
    out = F.lit("UNSUPPORTED")
    for name in reversed(names):
        out = F.when(F.contains(up, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def detect_format(path: Column, content: Column | None = None) -> Column:
    """Format by extension, else by the first bytes, else text."""
    ext = file_extension(path)
    found = F.when(ext.isin(".txt", ".md", ".markdown", ".rst", ".text"), "text").when(ext.isin(".html", ".htm", ".xhtml"), "html")
    found = found.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx")
    if content is not None:
        head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^\s+", ""))
        found = found.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(head.startswith("<!doctype") | head.startswith("<html"), "html")
    return found.otherwise("text")


def name_from_url(url: Column) -> Column:
    last = F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), -1)
    return F.when(last != "", last).otherwise("document")
