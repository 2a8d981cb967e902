import hashlib
import json
import math
import random
import re
import shutil
import tracemalloc
import urllib.error
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry.functions import models, text
from quarry.functions.filters import predicate
from quarry.operators import answers, augment, chunkers, metrics, rerank, retrieve, rewrite, stats
from quarry.operators.index import Corpus
from quarry.plans import catalog, export, registry
from quarry.plans.pipeline import build_pipeline, compare, evaluate, fingerprint, load_config, sampled
from quarry.plans.scorers import ScorerRegistry
from quarry.plans.stores import Store
from quarry.sources import datasets, files, parsers
from quarry.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


# ---- text


@pytest.mark.parametrize("raw", ["Grüße, Welt_2! ½ x", "", None, "日本語 テスト", "İlk it's", "\t\n"])
def test_tokens_equal_python(spark, raw):
    assert value(spark, text.tokens(F.lit(raw).cast("string"))) == re.findall(r"\w+", (raw or "").lower())


def test_stopwords():
    assert len(set(text.STOPWORDS["en"])) == 79 and text.stopwords("xx") is None and text.stopwords(True) == text.STOPWORDS["en"]
    assert text.stopwords({"A", "b"}) == ["a", "b"] and text.stopwords(None) is None


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(text.rewrite_rule(F.lit("What is THE best Python?"))) == "what best python"
    assert v(text.rewrite_rule(F.lit("the a an"))) == "the a an"
    assert v(text.round3(F.lit(0.0625))) == 0.062
    assert [v(text.verdict(F.lit(x))) for x in ("supported.", "UNSUPPORTED", "contradicted", "?")] == ["SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "UNSUPPORTED"]
    assert v(text.first_number(F.lit("score: 3.5"))) == 1.0 and v(text.first_number(F.lit("none"))) == 0.0
    assert v(text.json_list(F.lit('["a", 1]'))) == ["a", "1"] and v(text.json_list(F.lit("nope"))) == []
    assert v(text.sigmoid(F.lit(-800.0))) == 0.0 and v(text.sigmoid(F.lit(0.0))) == 0.5
    assert v(text.name_from_url(F.lit("https://a.example/x/y.html?q=1"))) == "y.html" and v(text.name_from_url(F.lit("https://a.example"))) == "document"
    assert v(text.detect_format(F.lit("a/b.HTM"))) == "html" and v(text.detect_format(F.lit("x"), F.lit(b"  <!DOCTYPE html>"))) == "html"
    assert v(text.snippet(F.lit("\xa0 a  b\nc"), 2)) == "a b" and v(text.is_binary(F.lit(b"a\0b")))


@pytest.mark.parametrize(
    ("where", "want"),
    [({"n": 3}, {1}), ({"n": {"$gt": 1, "$lte": 3}}, {1, 2}), ({"s": {"$in": ["a", None]}}, {1, 3}), ({"s": None}, {3}), ({"absent": None}, {1, 2, 3}), ({"absent": 1}, set()), ({"n": {"$gte": "1"}}, set()), ({"n": {"$near": 1}}, set()), ({"n": {}}, {1, 2, 3}), ({}, {1, 2, 3}), (None, {1, 2, 3}), ({"m.k": 7}, {2}), ({"b": 1}, {1})],
)
def test_filters(spark, where, want):
    df = spark.sql("SELECT * FROM VALUES (1, 3, 'a', named_struct('k', 5), true), (2, 2, 'b', named_struct('k', 7), false), (3, NULL, NULL, NULL, NULL) AS t(id, n, s, m, b)")
    assert {r.id for r in df.where(predicate(df, where)).collect()} == want
    assert df.where(~predicate(df, where)).count() == 3 - len(want)


# ---- chunkers


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(contents)], "doc_id string, content string").selectExpr("*", "1 AS id", "2 AS chunk_index")


def test_chunker_cases():
    assert chunkers.paragraphs("First.\n\nSecond.") == ["First.", "Second."]
    assert chunkers.paragraphs("# H\n\nBody.") == ["# H\n\nBody."]
    assert chunkers.paragraphs("body.\n\n# Last") == ["body.", "# Last"]
    assert chunkers.paragraphs("# A\n\n# B\n\nx") == ["# A", "# B\n\nx"]
    assert len(chunkers.paragraphs("a" * 120, 10)) >= 2
    snapped = "One two. Three four.\nFive six seven"
    assert chunkers.windows(snapped, 16, 3)[:3] == ["One two.", "wo.", "Three four."]
    assert chunkers.windows("ab\ncd\nef gh", 7, 0) == ["ab\ncd", "ef gh"]
    assert len(chunkers.packed(chunkers.sentences("Short one. Also short. Plus more text."), 15)) == 3
    plain = "x" * 1200
    assert [len(c) for c in chunkers.windows(plain)] == [500, 500, 300, 50] and [len(c) for c in chunkers.windows(plain, drop_tail=True)] == [500, 500, 300]
    assert chunkers.windows("word " * 50, 10, 20)
    same, other = [1.0, 0.0], [0.0, 1.0]
    assert len(chunkers.semantic_units("One. Two.", lambda p: [same, same])) == 1
    assert len(chunkers.semantic_units("One. Two.", lambda p: [same, other])) == 2
    assert chunkers.semantic_units("One. Two.", lambda p: [None, None]) == ["One. Two."]
    with pytest.raises(ValueError):
        chunkers.resolve("nope")


def test_sentence_expression_equals_python(spark):
    rng = random.Random(0)
    contents = [" ".join(rng.choice(["Short one.", "Is it? ", "Wow!  ", "a longer sentence of words.", "\xa0x.\n\n", "no end"]) for _ in range(rng.randrange(40))) for _ in range(30)] + [None, "", "  "]
    got: dict = {}
    for r in chunkers.sentence(docs(spark, *contents), 60).orderBy("chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
        assert r.id == f"{r.doc_id}_c{r.chunk_index}"
    want = {f"d{i}": chunkers.packed(chunkers.sentences(c), 60) for i, c in enumerate(contents) if c and c.strip()}
    assert got == {k: v for k, v in want.items() if v}


def test_chunkers_on_empty_and_null(spark):
    for f in (chunkers.fixed, chunkers.paragraph, chunkers.sentence):
        assert f(docs(spark, None, "", " ")).count() == 0 and f(docs(spark).limit(0)).count() == 0


# ---- retrieval


PASSAGES = [("c1", "the cat sat on the mat"), ("c2", "python is a programming language"), ("c3", "dogs are loyal animals"), ("c4", ""), ("c5", None), ("c6", "the cat sat on the mat")]


def corpus(spark, stop=None):
    df = spark.createDataFrame([(i, i.replace("c", "d"), c, "s" + i) for i, c in PASSAGES], "id string, doc_id string, content string, source string")
    return Corpus(df.selectExpr("*", "1 AS term", "2 AS tf"), stop)


def ask(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string").selectExpr("*", "0 AS id_")


def brute_bm25(query, k1=1.5, b=0.75):
    tok = {i: re.findall(r"\w+", (c or "").lower()) for i, c in PASSAGES}
    n, avg = len(tok), sum(map(len, tok.values())) / len(tok)
    out = {}
    for i, words in tok.items():
        tf, s = Counter(words), 0.0
        for t in set(re.findall(r"\w+", query.lower())):
            if tf[t]:
                df = sum(t in w for w in tok.values())
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_equals_brute_force_and_ties_go_to_the_smaller_id(spark):
    got = retrieve.bm25(ask(spark, "cat on the loyal mat", "", None, "zzz"), corpus(spark), 10).collect()
    want = brute_bm25("cat on the loyal mat")
    assert {r.id: pytest.approx(r.score) for r in got} == want and {r.qid for r in got} == {0}
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])][:2] == ["c1", "c6"]


def test_keyword_stopwords_synonyms_filters(spark):
    assert retrieve.keyword(ask(spark, "the on a"), corpus(spark, True), 5).count() == 0
    syn = retrieve.keyword(ask(spark, "feline"), corpus(spark), 1, synonyms={"Feline": ["cat"]}).collect()
    assert [r.id for r in syn] == ["c1"]
    full = retrieve.keyword(ask(spark, "cat"), corpus(spark), 5).collect()
    some = retrieve.keyword(ask(spark, "cat"), corpus(spark), 5, where={"source": "sc6"}).collect()
    assert [r.id for r in some] == ["c6"] and some[0].score == pytest.approx(full[0].score)
    assert retrieve.bm25(ask(spark, "cat"), Corpus(corpus(spark).chunks.limit(0)), 5).count() == 0


def test_dense_and_hybrid(spark):
    c = Corpus(corpus(spark).chunks.withColumn("embedding", models.bag_embedding(F.col("content"))))
    q = ask(spark, "loyal dogs", "python language").withColumn("embedding", models.bag_embedding(F.col("query")))
    best = {r.qid: r.id for r in retrieve.semantic(q, c, 1).collect()}
    assert best == {0: "c3", 1: "c2"}
    mixed = retrieve.hybrid(q, c, 3).collect()
    assert {r.qid: r.id for r in mixed if r["rank"] == 1} == best and {r.retrieval_method for r in mixed} == {"hybrid"}
    fallback = retrieve.semantic_or_keyword(q.withColumn("embedding", F.when(F.col("qid") == 0, F.col("embedding"))), c, 1).collect()
    assert {r.qid: r.retrieval_method for r in fallback} == {0: "semantic", 1: "semantic (fallback to keyword)"}
    assert models.BagEmbedder()(["loyal dogs"])[0] == q.where("qid = 0").collect()[0].embedding
    odd = Corpus(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("n", None), ("e", [])], "id string, embedding array<double>"))
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, embedding array<double>")
    got = retrieve.semantic(one, odd, 5).collect()
    assert {r.id for r in got} == {"a", "b"} and all(abs(r.score - 1) < 1e-6 for r in got)
    exact = spark.sql("SELECT array(1D, 2D) AS a, array(2D, 4D) AS b").select(retrieve.cosine(F.col("a"), F.col("b")).alias("c")).collect()[0].c
    assert exact == pytest.approx(1.0)


def test_rerank(spark):
    rows = [("c1", "cats are great pets"), ("c2", "dogs are loyal pets"), ("c3", "the sun is a star")]
    c = Corpus(spark.createDataFrame([(i, i, t, i) for i, t in rows], "id string, doc_id string, content string, source string"))
    q = ask(spark, "dogs loyal pets are")
    base = retrieve.bm25(q, c, 3)
    top = rerank.overlap(base, q, c.chunks, 3).orderBy("rank").collect()
    assert top[0].id == "c2" and top[0].retrieval_method == "rerank:mock(bm25)"
    assert [r.id for r in rerank.overlap(base, q, c.chunks, 3, 0.9).collect()] == ["c2"]
    assert {r.retrieval_method for r in rerank.overlap(base, q, c.chunks, 3, 2.0).collect()} == {"bm25"}
    udf = rerank.cross_encoder(base, q, c.chunks, 3, rerank.overlap_scorer, "mock").collect()
    assert {r.id: r.score for r in udf} == {r.id: r.score for r in top}
    failed = rerank.cross_encoder(base, q, c.chunks, 3, lambda q, d: None, "jina").orderBy("rank").collect()
    assert failed[0].retrieval_method == "rerank:failed(jina,bm25)" and failed[0].id == "c2"
    assert rerank.cross_encoder(base, q, c.chunks, 3, lambda q, d: [(99, 1.0), (0, 0.5)], "jina").count() == 1
    assert rerank.depth(5) == 15 and rerank.depth(1) == 6 and rerank.depth(90, 3, "cohere") == 100
    assert rerank.build_scorer(None) is None and rerank.build_scorer({"provider": "mock"})[1] == "mock"
    with pytest.raises(ValueError):
        rerank.build_scorer({"provider": "zzz"})


def test_rewrite(spark):
    q = ask(spark, "What is THE best Python?", "the a an")
    assert {r.qid: r.query for r in rewrite.rewrite(q).collect()} == {0: "what best python", 1: "the a an"}
    chat = models.PatternChat({"THE best": "python"})
    got = {r.qid: (r.query, r.rewrite_method) for r in rewrite.rewrite(q, "llm", chat).collect()}
    assert got == {0: ("python", "llm"), 1: ("the a an", "rule-fallback")}


# ---- context


def ranked(spark):
    rows = [(1, 1, "c1", 0.9, "bm25", "d1", "same", "s1"), (1, 2, "c2", 0.8, "bm25", "d2", "same", None), (1, 3, "c3", 0.1, "bm25", "d3", "other", "s3")]
    return spark.createDataFrame(rows, "qid long, rank int, id string, score double, retrieval_method string, doc_id string, content string, source string")


def test_context(spark):
    q = spark.createDataFrame([(1, "q"), (2, "r")], "qid long, query string")
    got = {r.qid: r.context for r in augment.cited_context(q, ranked(spark)).collect()}
    assert got[1] == "[1] [Source: s1]\nsame\n---\n[2] [Source: s3]\nother" and got[2] == augment.EMPTY
    gated = {r.qid: r.message for r in augment.in_memory(q, ranked(spark), 0.5).collect()}
    assert gated == {1: "Document context:\n---\n[1] [Source: s1]\nsame\n---\n\nQuestion: q", 2: "r"}
    ev = {r.qid: r.context for r in augment.evaluation_context(q, ranked(spark)).collect()}
    assert ev[2] == augment.NO_CONTEXT and ev[1].count("\n\n") == 2
    md = augment.markdown(ranked(spark)).collect()[0].text
    assert md.startswith("[1] [Source: s1] (score: 0.900, method: bm25)\nsame\n\n---\n\n[2] [Source: d2]")


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "assistant", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.turn, r.query) for r in augment.last_user_turns(conv).collect()] == [(1, 2, "c")]
    ctx = spark.createDataFrame([(1, "CTX"), (2, "Y")], "conv_id long, context string")
    out = {(r.conv_id, r.turn): r.text for r in augment.on_the_fly(conv, ctx).collect()}
    assert out[1, 2].endswith("Question: c") and "CTX" in out[1, 2] and out[1, 0] == "a" and out[2, 0] == "x"


# ---- metrics


def measure(spark, contents, needles, k):
    cases = spark.createDataFrame([(1, needles)], "qid long, gold_needles array<string>").selectExpr("*", "0 AS rank")
    rows = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(contents)], "qid long, rank int, content string")
    return metrics.per_query(cases, rows, k).collect()[0]


def test_metrics(spark):
    m = measure(spark, ["hello world", "foo bar"], ["HELLO"], 5)
    assert (m.recall, m.precision, m.hit, m.mrr, m.ndcg) == (1.0, 0.2, 1.0, 1.0, 1.0)
    m = measure(spark, ["x", "gold a", None], ["gold", "gold", "zzz", "", None], 2)
    assert m.recall == pytest.approx(1 / 3) and m.mrr == 0.5 and m.ndcg == pytest.approx(1 / math.log2(3))
    none = measure(spark, ["x"], None, 3)
    assert (none.recall, none.precision, none.hit, none.mrr, none.ndcg) == (1.0, 0.0, 0.0, 0.0, 0.0)
    nothing = measure(spark, [], ["g"], 3)
    assert nothing.recall == 0.0 and nothing.ndcg == 0.0
    late = measure(spark, ["x", "y", "g"], ["g"], 2)
    assert late.hit == 0.0 and late.recall == 0.0
    with pytest.raises(ValueError):
        metrics.metric_name("nope")
    assert metrics.metric_name("hit_rate") == "hit"


def test_answers(spark):
    cite = lambda a, s: value(spark, answers.citation_precision(F.lit(a), F.array(*map(F.lit, s))))
    assert cite("[1] [Source: a.md] [9]", ["a.md", "b.md"]) == pytest.approx(2 / 3) and cite("none", ["a"]) == 1.0 and cite("[Source: 3]", ["a"]) == 0.0
    right = lambda a, e: value(spark, answers.answer_correctness(F.lit(a).cast("string"), F.lit(e).cast("string")))
    assert right("The answer is 42!", "answer is 42") == 1.0 and right("x", None) == 1.0 and right("red fox", "red dog") == 0.5 and right(None, "a") == 0.0
    assert value(spark, answers.correctness_score(F.lit(""), F.lit("a"))) == 0.0
    assert value(spark, answers.abstention(F.lit("Sorry, I don't know."), F.lit(True))) == 1.0
    assert value(spark, answers.abstention(F.lit("It is 4."), F.lit(True))) == 0.0 and value(spark, answers.abstention(F.lit("x"), F.lit(None).cast("boolean"))) == 1.0


def test_faithfulness(spark):
    chat = models.PatternChat({"separate factual claims": '["a", "b"]', "For each claim": '["SUPPORTED", "unsupported"]'})
    assert answers.judge_faithfulness(chat, "x", "ctx") == 0.5
    per = models.PatternChat({"separate factual claims": '["a", "b"]', "For each claim": "[]", "this claim": "SUPPORTED"})
    assert answers.judge_faithfulness(per, "x", "ctx") == 1.0 and answers.judge_faithfulness(chat, "", "ctx") == 1.0
    assert answers.judge_faithfulness(lambda p: 1 / 0, "x", "c") == 0.0
    assert answers.judge_faithfulness(lambda p: "FAITHFULNESS: 0.7", "x", "c", "single") == 0.7
    df = spark.createDataFrame([(1, "x", "ctx")], "qid long, answer string, context string")
    assert answers.faithfulness(df, chat).collect()[0].value == 0.5
    assert answers.judged_correctness(lambda p: "0.25", "a", "b") == 0.25 and answers.judged_correctness(None, "a", "b") is None


def test_statistics(spark):
    assert stats.interval([]) == (0.0, 0.0, 0.0) and stats.interval([0.4]) == (0.4, 0.0, 1.0)
    mean, low, high = stats.interval([0.9] * 27 + [0.91])
    assert high - low < 0.05 and low <= mean <= high
    rows = [(i, "recall", float(i % 2)) for i in range(130)]
    long = spark.createDataFrame(rows, "qid long, name string, value double")
    exact, native = stats.bootstrap(long).collect()[0], stats.bootstrap_native(long, 200).collect()[0]
    assert abs(exact.ci_low - native.ci_low) < 0.05 and exact.n == native.n == 130
    assert (exact.mean, exact.ci_low, exact.ci_high) == stats.interval([v for _, _, v in rows])
    summary = spark.createDataFrame([("recall", 0.9, 0.86, 0.95, 150), ("mrr", 0.3, 0.2, 0.4, 150)], "name string, mean double, ci_low double, ci_high double, n long")
    d = {r.dimension: r.status for r in stats.rubric(summary).collect()}
    assert d["ranking_recall"] == "PASS" and d["ranking_mrr"] == "FAIL" and d["abstention"] == "NA" and len(d) == 10
    final = stats.decision(stats.rubric(summary)).collect()[0]
    assert not final.overall_pass and final.min_n_ok and final.weighted_score == pytest.approx(0.08 / 0.13)
    better = long.withColumn("value", F.lit(1.0))
    c = stats.compare(long, better).collect()[0]
    assert c.delta == 0.5 and c.significant
    assert not stats.compare(long, long).collect()[0].significant


# ---- sources


def test_parsers():
    assert parsers.parse("a.txt", "héllo".encode()) == ("héllo", {"source_format": "text"})
    assert parsers.parse("a.txt", b"caf\xe9")[0] == "café" and parsers.parse("a.txt", b"a\0b") == ("", {"source_format": "binary"})
    assert parsers.parse("a.txt", b"\xef\xbb\xbfx")[0] == "﻿x"
    assert parsers.parse("a.html", b"<p>Hello</p><p>world</p>")[0] == "Hello world"
    assert parsers.strip_tags("<script>x()</script><b> y </b>") == "x() y"
    assert parsers.detect("x", b"%PDF-1") == "pdf" and parsers.detect("x", b" <html>") == "html" and parsers.detect("x.MD", b"") == "text"
    assert parsers.parse("x.pdf", b"%PDF-broken")[0] in ("", "%PDF-broken")
    assert parsers.markdown_table([["a|b", None], [1, "c"]]) == "| a/b |  |\n| --- | --- |\n| 1 | c |"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("alpha text")
    (tmp_path / "sub" / "b.html").write_text("<p>beta</p>")
    (tmp_path / "blank.txt").write_text("  \n")
    (tmp_path / "big.txt").write_text("x" * 5000)
    got = {r.doc_id: (r.content, r.source_format) for r in files.documents(spark, [str(tmp_path)], 0.001).collect()}
    assert got == {"a": ("alpha text", "text"), "b": ("beta", "html")}
    assert files.documents(spark, [{"path": str(tmp_path / "*.txt")}]).count() == 2
    assert files.documents(spark, [str(tmp_path / "absent"), 7, {"source": "odd"}]).count() == 0
    a, b = files.source_key({"url": "x", "token": "1"}), files.source_key({"url": "x", "token": "2"})
    assert a == b and len(a) == 32


class Answer:
    def __init__(self, body, headers=None):
        self.body, self.headers = body, headers or {}

    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False

    def read(self, n=-1):
        return self.body if n < 0 else self.body[:n]


class Opener:
    def __init__(self, *steps):
        self.steps, self.urls = list(steps), []

    def open(self, request, timeout):
        self.urls.append(request.full_url)
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def http_error(code, headers=None):
    return urllib.error.HTTPError("http://a", code, "", headers or {}, None)


def test_fetch():
    ok = Opener(http_error(503), http_error(302, {"Location": "/next"}), Answer(b"body"))
    assert files.fetch("http://a.example/x", guard=lambda h: True, opener=ok) == b"body" and ok.urls[-1] == "http://a.example/next"
    with pytest.raises(PermissionError):
        files.fetch("http://127.0.0.1/x", opener=Opener())
    with pytest.raises(PermissionError):
        files.fetch("http://a.example", guard=lambda h: h == "a.example", opener=Opener(http_error(302, {"Location": "http://inner/"})))
    with pytest.raises(ValueError):
        files.fetch("http://a.example", max_bytes=2, guard=lambda h: True, opener=Opener(Answer(b"body")))
    with pytest.raises(urllib.error.HTTPError):
        files.fetch("http://a.example", guard=lambda h: True, opener=Opener(http_error(404)))


def test_crawl_and_http(spark):
    def call(path, body=None):
        return {"id": "1"} if body else {"status": "completed", "data": [{"markdown": "# x", "metadata": {"sourceURL": "https://a.example/p"}}, {"html": ""}]}

    crawl = lambda call: files.crawl(spark, "https://a.example", call=call, wait=0, polls=2, guard=lambda h: h == "a.example")
    assert [r.path for r in crawl(call).collect()] == ["p.md"]
    for state in ({"status": "failed"}, {"status": "scraping", "data": None}, {}):
        with pytest.raises(files.Incomplete):
            crawl(lambda path, body=None, state=state: {"id": "1"} if body and state else state)
    with pytest.raises(PermissionError):
        files.crawl(spark, "https://a.example", call=call, guard=lambda h: False)
    fetched = files.http(spark, ["https://a.example/ok.txt", "https://a.example/bad"], fetcher=lambda u, *a: b"yes" if u.endswith("txt") else 1 / 0)
    assert [(r.path, bytes(r.content)) for r in fetched.collect()] == [("ok.txt", b"yes")]


def test_datasets(spark, tmp_path):
    j = tmp_path / "q.json"
    j.write_text(json.dumps({"name": "mine", "corpus_dir": "c", "qrels": [{"query": "a", "doc_id": "d", "gold_needles": "n"}, {"query": "b", "out_of_scope": True}]}))
    name, q, folder = datasets.resolve(spark, "json", str(j))
    rows = q.orderBy("qid").collect()
    assert (name, folder, rows[0].gold_needles, rows[0].gold_doc, rows[1].out_of_scope) == ("mine", "c", ["n"], "d", True)
    c = tmp_path / "q.csv"
    c.write_text("query,needles,expected_answer\nwhat,a | b|,x\n")
    assert datasets.csv_qrels(spark, str(c)).collect()[0].gold_needles == ["a", "b"]
    with pytest.raises(ValueError):
        datasets.resolve(spark, "absent")
    p = spark.createDataFrame([(1, "q", "one two " * 8, True, 1), (1, "q", "other", True, 0), (2, "r", "other", False, 0)], "qid long, query string, text string, selected boolean, pos int")
    corpus_rows, qrels = datasets.passage_corpus(p)
    assert corpus_rows.count() == 2 and qrels.collect()[0].gold_needles == ["other"]
    rows = spark.createDataFrame([(1, "q", "ctx", "an answer")], "qid long, query string, context string, answer string")
    more = spark.createDataFrame([("d" * 90 + str(k),) for k in range(5)] + [("short",)], "text string")
    corpus_rows, qrels = datasets.answer_corpus(rows, more, 1, density=4)
    assert corpus_rows.count() == 4 and qrels.collect()[0].gold_needles == ["an answer"]


def test_clients():
    calls = []

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise http_error(429, {"Retry-After": "0"})
        return Answer(b'{"x": 1}')

    assert models.post("http://a", {}, sleep=lambda s: None, opener=opener) == {"x": 1}
    from quarry import errors

    for code, kind in ((401, errors.ModelAuthError), (429, errors.ModelRateError), (500, errors.ModelServerError), (400, errors.ModelRequestError)):
        def fail(request, timeout, code=code):
            raise http_error(code)

        with pytest.raises(kind):
            models.post("http://a", {}, retries=0, opener=fail)
    with pytest.raises(errors.ModelAnswerError):
        models.post("http://a", {}, opener=lambda r, timeout: Answer(b"no json"))


def test_embedding_cache(spark, tmp_path):
    c = spark.createDataFrame([("a b",), ("c",), ("a b",)], "content string")
    assert models.cached_vectors(c, models.BagEmbedder(), str(tmp_path), "bag/1").count() == 2
    more = c.union(spark.createDataFrame([("new",)], "content string"))
    assert models.cached_vectors(more, models.BagEmbedder(), str(tmp_path), "bag/1").count() == 3


def test_failed_reads_are_not_cached(spark, tmp_path):
    spec, tries = {"source": "http", "url": "https://a.example"}, []
    page = spark.createDataFrame([("p.md", 1, bytearray(b"x"))], files.SCHEMA)

    def read():
        tries.append(1)
        if len(tries) == 1:
            raise files.Incomplete("half done")
        return files.none(spark) if len(tries) == 2 else page

    got = [files.cached(spark, spec, str(tmp_path), read).count() for _ in range(4)]
    assert got == [0, 0, 1, 1] and len(tries) == 3


def test_rerank_fails_softly(spark):
    rows = [("c1", "cats are great pets"), ("c2", "dogs are loyal pets")]
    c = Corpus(spark.createDataFrame([(i, i, t, i) for i, t in rows], "id string, doc_id string, content string, source string"))
    q = ask(spark, "loyal pets")
    base = retrieve.bm25(q, c, 2)
    for scores in ([], [(99, 1.0)], [("x", None)], [(0, float("nan"))], None, 7):
        got = rerank.cross_encoder(base, q, c.chunks, 2, lambda q, d, scores=scores: scores, "jina").orderBy("rank").collect()
        assert [r.id for r in got] == ["c2", "c1"] and {r.retrieval_method for r in got} == {"rerank:failed(jina,bm25)"}


def test_saved_index_gives_the_same(spark, tmp_path):
    plain = corpus(spark)
    saved = Corpus.load(spark, plain.save(str(tmp_path / "i")) and str(tmp_path / "i"))
    q = ask(spark, "cat on the loyal mat mat", "python zzz", "", None)
    for search in (retrieve.bm25, retrieve.keyword):
        want, got = ({(r.qid, r.id, r["rank"], round(r.score, 12)) for r in search(q, c, 4).collect()} for c in (plain, saved))
        assert want and got == want
    empty = Corpus(plain.chunks.limit(0)).save(str(tmp_path / "e"))
    assert retrieve.bm25(q, empty, 3).count() == retrieve.keyword(q, empty, 3).count() == 0


def test_draws_are_those_of_the_generator():
    for n in (2, 7, 64, 300):
        rng = random.Random(5)
        assert list(stats.draws(n, 500, 5)) and [int(x) for d in stats.draws(n, 500, 5, 100) for x in d] == [rng.randrange(n) for _ in range(500)]


def test_registered_parsers_and_augmentations_take_effect(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    own = parsers.PARSERS | {"text": lambda data: (data.decode().upper(), {"source_format": "loud"})}
    assert [(r.content, r.source_format) for r in files.documents(spark, [str(tmp_path)], parsers=own).collect()] == [("ALPHA", "loud")]
    registry.augmentation.register("bare")(lambda queries, results, relevance_threshold=None: queries.select("qid", F.lit("bare").alias("message")))
    pipe = build_pipeline(spark, {"retriever": "bm25", "augmentation": "bare"}, datasets.synthetic_chunks(spark))
    assert pipe.augmented(ask(spark, "dna")).collect()[0].message == "bare"
    pipe.conf["augmentation"] = "in_memory"
    assert "double helix" in pipe.augmented(ask(spark, "dna genetic instructions")).collect()[0].message
    pipe.close()


# ---- composition


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "photosynthesis converts sunlight into energy", "bio"), ("c2", "gravity attracts two masses", "phys")], "id string, content string, source string")
    for path in (None, str(tmp_path / "s")):
        store = Store(spark, "memory", path, models.BagEmbedder())
        q = spark.createDataFrame([(1, "gravity masses")], "qid long, query string")
        assert store.search(q).count() == 0 and store.count() == 0
        store.add(rows)
        store.add(rows.where("id = 'c2'"))
        assert store.count() == 2
        store.compact()
        assert store.count() == 2
        best = store.search(q, 1).collect()[0]
        assert (best.id, best.retrieval_method) == ("c2", "vectorstore:memory")
        assert [r.id for r in store.search(q, 5, {"source": "bio"}).collect()] == ["c1"]
    with pytest.raises(ValueError):
        Store(spark, "nope")


def test_pipeline_end_to_end(spark, tmp_path):
    for name, content in datasets.CORPUS:
        (tmp_path / f"{name}.txt").write_text(content)
    conf = {"documents": [str(tmp_path)], "retriever": "bm25", "chunker": "paragraph", "k1": 1.2, "rerank": {"provider": "mock"}}
    pipe = build_pipeline(spark, conf)
    best = pipe.retrieve(ask(spark, "what force attracts two masses together"), 2).where("rank = 1").collect()[0]
    assert best.doc_id == "doc_gravity" and best.retrieval_method == "rerank:mock(bm25)"
    report = evaluate(pipe, datasets.synthetic_qrels(spark), "synthetic", 10, generate=lambda p: "I don't know [1]", judge=models.PatternChat({}, "[]"))
    means = {r.name: r.mean for r in report.summary.collect()}
    assert means["recall"] >= 0.8 and means["faithfulness"] == 1.0 and not report.overall["min_n_ok"] and not report.overall["overall_pass"]
    assert "overall: FAIL" in report.text() and report.config_hash != fingerprint({}, "synthetic", [], 10, 5)
    other = build_pipeline(spark, {"retriever": "hybrid"}, datasets.synthetic_chunks(spark), models.BagEmbedder())
    assert compare(pipe, other, datasets.synthetic_qrels(spark), "mrr", 5).count() == 1
    assert build_pipeline(spark, {}) is None and build_pipeline(spark, {"enabled": False}) is None
    assert sampled(datasets.synthetic_qrels(spark), 3).count() == 3
    store = build_pipeline(spark, {"retriever": "vectorstore"}, datasets.synthetic_chunks(spark), models.BagEmbedder())
    assert store.retrieve(ask(spark, "double helix DNA"), 1).collect()[0].doc_id == "doc_dna"
    assert "doc_dna" in export.search(spark, other, "genetic instructions DNA", 2) and export.search(spark, pipe, "zzz") == "No passages found."


def test_registry_scorers_config(spark, tmp_path):
    r = registry.Registry("thing", {"a": lambda x: x})
    with pytest.raises(ValueError):
        r.register("b", {"key": "absent"})(lambda x: x)
    r.register("b", {"key": "size"})(lambda size=1: size)
    assert r.settings("b", {"key": 3, "other": 1}) == {"size": 3} and r.names() == ["a", "b"]
    with pytest.raises(ValueError):
        r.get("zzz")
    assert registry.load_custom(["json", "no_such_module_x"]) == ["json"]
    s = ScorerRegistry()
    cases = spark.createDataFrame([(1, ["g"]), (2, [])], "qid long, gold_needles array<string>")
    rows = spark.createDataFrame([(1, 1, "g")], "qid long, rank int, content string")
    got = {x.qid: x.value for x in s.create("retrieval_recall")(cases, rows).collect()}
    assert got == {1: 1.0, 2: 0.0}
    assert s.create("bootstrap_ci")(cases, rows).count() == 1
    assert list(s.from_config([{"name": "retrieval_mrr", "k": 3}, {"name": "zzz"}])) == ["retrieval_mrr"]
    (tmp_path / "c.yaml").write_text("retriever: bm25\n")
    (tmp_path / "l.yaml").write_text("- 1\n")
    assert load_config(str(tmp_path / "c.yaml")) == {"retriever": "bm25"}
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "l.yaml"))


def test_export_and_command_line(capsys):
    from quarry.__main__ import main, metric_at

    assert export.rendered("mcp")["inputSchema"] == export.rendered("canonical")["input_schema"] == export.rendered("openai")["function"]["parameters"]
    assert export.rendered("canonical") == export.tool_schema() and export.rendered("openai")["type"] == "function"
    assert export.openai_arguments({"function": {"name": "search", "arguments": '{"query": "x"}'}}) == {"query": "x"}
    assert export.anthropic_arguments({"name": "search", "input": {"query": "y"}}) == {"query": "y"}
    assert main(["export-tool-schema", "--form", "anthropic"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "search"
    assert metric_at("mrr@5") == ("mrr", 5) and metric_at("recall") == ("recall", 10)


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One sentence. Two sentences.")
    out = str(tmp_path / "out")
    for step in range(2):
        ingest.ingest(ingest.stream_files(spark, str(tmp_path / "in")), out, str(tmp_path / "cp")).awaitTermination(60)
        if step == 0:
            (tmp_path / "in" / "b.txt").write_text("Another file.")
    assert {r.doc_id for r in spark.read.parquet(out).collect()} == {"a", "b"}


# ---- registered queries


SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_give_the_rows_of_their_sql(same_as_sql, name):
    same_as_sql(catalog.queries()[name], SQL[name])


def test_queries_without_sql(spark, data):
    known = catalog.queries()
    assert {n for n in known if n not in SQL} == {"bootstrap_exact", "rubric_exact", "scorer_interval", "semantic_chunks"}
    means = {r.name: (r.mean, r.n) for r in known["metric_means"](spark, data).collect()}
    exact = {r.name: r for r in known["bootstrap_exact"](spark, data).collect()}
    assert {n: (r.mean, r.n) for n, r in exact.items()} == means and all(r.ci_low <= r.mean <= r.ci_high for r in exact.values())
    low = known["scorer_interval"](spark, data).collect()[0].value
    per = [r.value for r in ScorerRegistry().create("retrieval_mrr", k=5)(catalog.qrels(spark, data), catalog.results(spark, data)).orderBy("qid").collect()]
    assert low == round(stats.interval(per, 1000)[1], 3)
    texts = {r.doc_id: r.content for r in catalog.documents(spark, data).collect() if (r.content or "").strip()}
    pieces: dict = {}
    for r in known["semantic_chunks"](spark, data).orderBy("chunk_index").collect():
        pieces.setdefault(r.doc_id, []).append(r.content)
    assert pieces == {d: chunkers.semantic_units(t, models.BagEmbedder()) for d, t in texts.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_exact_rubric_covers_every_ranking_metric(spark, data):
    status = {r.dimension: r.status for r in catalog.queries()["rubric_exact"](spark, data).collect()}
    assert len(status) == len(stats.RUBRIC)
    assert all(status[d] in ("PASS", "FAIL") for d in ("ranking_recall", "ranking_mrr", "ranking_ndcg")) and status["faithfulness"] == "NA"


SEARCHES = ["bm25_topk", "keyword_topk", "rerank_overlap_topk", "rerank_soft_topk", "compare_deltas", "hybrid_rrf_topk", "semantic_fallback_topk", "bm25_stopwords_topk", "keyword_filtered_topk", "bm25_filtered_topk", "bm25_synonyms_topk", "compare_interval", "rerank_threshold_topk", "rewritten_topk"]


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_save_no_postings(spark, tmp_path, name):
    """Of chunks without an index a search saves the chunks alone."""
    for t in ("chunks", "qrels"):
        shutil.copy(f"/root/testdata/sf0.01/{t}.parquet", tmp_path)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.glob("quarry-index-*")}
    getattr(catalog, name)(spark, str(tmp_path))
    fresh = {*shared.glob("quarry-index-*")} - before
    assert len(fresh) == 1 and not any((p / "postings").exists() for p in fresh)


def test_equal_chunks_of_a_search(spark):
    """More equal chunks than are kept: the smaller ids; queries of the same words each have their rows."""
    rows = [(f"c{i:03}", f"d{i}", "cat mat" if i % 3 else "cat", "s") for i in range(300)]
    c = Corpus(spark.createDataFrame(rows, "id string, doc_id string, content string, source string").repartition(5))
    for search in (retrieve.bm25, retrieve.keyword):
        got = search(ask(spark, "cat", "mat", "cat"), c, 4).collect()
        assert {q: [r.id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in range(3)} == {0: ["c000", "c003", "c006", "c009"], 1: ["c001", "c002", "c004", "c005"], 2: ["c000", "c003", "c006", "c009"]}


def test_native_draws(spark):
    """Draws equal hashlib's, and blocks of questions add up."""
    for n in (1, 9, 1234):
        got = [int(x) for part in stats.native_draws(42, 17, n, 100) for x in part]
        assert got == [int(hashlib.md5(f"42|17|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
    rows = spark.createDataFrame([(q, m, (q * 7 % 11) / 10) for m, n in (("a", 25), ("b", 25), ("c", 8)) for q in range(n)], "qid long, name string, value double")
    whole = stats.bootstrap_native(rows, 50)
    assert sorted(map(str, stats.bootstrap_native(rows, 50, block=10).withColumns({c: F.round(c, 9) for c in ("ci_low", "ci_high")}).collect())) == sorted(map(str, whole.withColumns({c: F.round(c, 9) for c in ("ci_low", "ci_high")}).collect()))


DRAWS = ["bootstrap_native", "rubric_decision", "rubric_dimensions"]


@pytest.mark.parametrize("name", DRAWS)
def test_draws_are_no_rows(spark, data, name):
    """Draws that are rows of a join may be broadcast."""
    assert "md5" not in getattr(catalog, name)(spark, data)._jdf.queryExecution().toString().lower()


VALUES = ["rubric_decision", "rubric_dimensions"]


@pytest.mark.parametrize("name", VALUES)
def test_values_are_no_objects(spark, data, monkeypatch, name):
    """The driver gets a metric's values as columns, not as rows of objects."""
    monkeypatch.setattr(catalog, "_long", lambda *_: spark.range(50_000).selectExpr("id AS qid", "'mrr' AS name", "rand(1) AS value"))
    tracemalloc.start()
    try:
        getattr(catalog, name)(spark, data)
        assert tracemalloc.get_traced_memory()[1] < 4_000_000
    finally:
        tracemalloc.stop()


def test_equal_vectors_of_a_search(spark, monkeypatch):
    """Of chunks of one score as many rows as are kept leave a batch, and they are those of the smaller ids."""
    rows = [(f"c{i:04}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(2000)]
    c = Corpus(spark.createDataFrame([(i, v) for i, v in rows[::-1]], "id string, embedding array<double>").repartition(4))
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "qid long, embedding array<double>")
    got = sorted((r.qid, r.rank, r.id) for r in retrieve.semantic(q, c, 3).collect())
    assert [(g, i) for g, _, i in got] == [(1, "c0000"), (1, "c0001"), (1, "c0002"), (2, "c0001"), (2, "c0003"), (2, "c0005"), (3, "c0000"), (3, "c0002"), (3, "c0004")]
    monkeypatch.setattr(retrieve, "top_k", lambda scored, *_: scored)
    assert retrieve.semantic(q, c, 3).count() <= 4 * 3 * 3


EVERY = ["rerank_overlap_topk", "bm25_stopwords_topk", "rewritten_topk"]


@pytest.mark.parametrize("name", EVERY)
def test_searches_take_every_question(spark, data, name):
    """Every golden question that shares a word with a chunk has results, not those of some qids alone."""
    stop = "en" if "stopwords" in name else None
    questions = catalog.asked_all(spark, data)
    questions = rewrite.rewrite(questions) if name == "rewritten_topk" else questions
    words = questions.select("qid", F.explode(text.tokens(F.col("query"), stop)).alias("term"))
    known = catalog.chunks(spark, data).select(F.explode(text.tokens(F.col("content"), stop)).alias("term")).distinct()
    want = {r.qid for r in words.join(known, "term").select("qid").distinct().collect()}
    got = {r.qid for r in getattr(catalog, name)(spark, data).select("qid").distinct().collect()}
    assert got == want and any(q % 50 for q in got)


@pytest.mark.parametrize("search", ["bm25", "keyword"])
def test_searches_by_bounds(spark, monkeypatch, search):
    """What is left out by bounds, in meetings of few chunks, is not among the best."""
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:04}", " ".join(words[int(40 * ((i * 7919 + j * 104729) % 9973 / 9973) ** 3)] for j in range(3 + i % 9))) for i in range(900)]
    c = Corpus(spark.createDataFrame(rows, "id string, content string").repartition(3))
    q = ask(spark, *[" ".join(words[(i * j * j + j) % 40] for j in range(1, 2 + i % 6)) for i in range(60)])

    def found():
        return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in getattr(retrieve, search)(q, c, 5).collect())

    best_hits = retrieve.best_hits

    def small(*args):
        with pytest.MonkeyPatch.context() as own:  # in the worker
            for what, n in {"OPENING": 8, "MEETING": 32, "AT_ONCE": 8, "DENSE": 3}.items():
                own.setattr(retrieve, what, n)
            yield from best_hits(*args)

    whole = getattr(retrieve, search)(q, c, 1000).where("rank <= 5")
    want = sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in whole.collect())
    monkeypatch.setattr(retrieve, "best_hits", small)
    assert found() == want


def test_deltas_of_every_question(spark, data):
    """Every golden question is compared."""
    got = [r.qid for r in catalog.compare_deltas(spark, data).select("qid").collect()]
    assert sorted(got) == sorted(r.qid for r in catalog.asked_all(spark, data).where("qid IS NOT NULL").collect()) and any(q % 50 for q in got)
