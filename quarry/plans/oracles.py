"""The registered queries in SQL for another engine, over the same tables."""

from __future__ import annotations

from quarry.functions.text import FILLERS, REFUSALS, STOPWORDS
from quarry.operators.augment import EMPTY, NO_CONTEXT
from quarry.operators.stats import LEAST_CASES, RUBRIC
from quarry.sources.datasets import CORPUS, QUESTIONS


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: A dotted capital I is small i and a combining dot in Unicode's full lower case.
TOK = r"regexp_extract_all(lower(replace(coalesce({}, ''), 'İ', 'i' || chr(775))), '[\p{{L}}\p{{N}}_]+')"
EN = _list(STOPWORDS["en"])

CHUNKS = """c AS (SELECT id, any_value(doc_id) AS doc_id, any_value(content) AS content, any_value(metadata.source) AS source,
    any_value(metadata.source_format) AS source_format, any_value(metadata.lang) AS lang, any_value(metadata.chunk_index) AS chunk_index
    FROM chunks GROUP BY id)"""
QRELS = """q AS (SELECT qid, any_value(query) AS query, any_value(gold_needles) AS gold_needles, any_value(out_of_scope) AS oos FROM qrels GROUP BY qid)"""
ASKED = "a AS (SELECT qid, query FROM q WHERE qid % 50 = 0 AND query IS NOT NULL)"
ASKED_ALL = "a AS (SELECT qid, query FROM q WHERE query IS NOT NULL)"
RESULTS = """r AS (SELECT x.qid, x.rank_no AS rank, x.chunk_id AS id, x.doc_id, x.score, x.retrieval_method, c.content, c.source FROM
    (SELECT qid, rank_no, any_value(chunk_id) AS chunk_id, any_value(doc_id) AS doc_id, any_value(score) AS score, any_value(retrieval_method) AS retrieval_method FROM results GROUP BY qid, rank_no) x
    LEFT JOIN c ON c.id = x.chunk_id)"""
ANSWERS = """w AS (SELECT qid, any_value(answer) AS answer, any_value(retrieved) AS retrieved, any_value(expected) AS expected, any_value(out_of_scope) AS oos FROM answers GROUP BY qid)"""
WHERE = "source_format IN ('html', 'text') AND chunk_index >= 2 AND lang = 'en'"


def _terms(stop) -> str:
    words = {True: EN, "id": _list(STOPWORDS["id"])}.get(stop)
    return f"[x FOR x IN {{}} IF NOT list_contains({words}, x)]" if words else "{}"


def _index(stop=False) -> str:
    t = _terms(stop).format(TOK.format("content"))
    return f"""{CHUNKS}, t AS (SELECT id, {t} AS terms FROM c), dl AS (SELECT id, len(terms) AS dl FROM t),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM t) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""


def _ranked(scored: str, k: int, method: str) -> str:
    return f"""SELECT qid, rank, id, round(score, 6) AS score, '{method}' AS retrieval_method FROM
    (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ({scored})) WHERE rank <= {k}"""


def _bm25_scores(stop: bool = False, terms: str | None = None) -> tuple[str, str]:
    q = terms or _terms(stop).format(TOK.format("query"))
    ctes = f"WITH {_index(stop)}, {QRELS}, {ASKED}, qt AS (SELECT DISTINCT qid, unnest({q}) AS term FROM a)"
    scored = """SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))) AS score
    FROM qt JOIN df USING (term) JOIN p USING (term) JOIN dl USING (id) CROSS JOIN s GROUP BY qid, id"""
    return ctes, scored


def _keyword_scores() -> tuple[str, str]:
    ctes = f"""WITH {_index()}, {QRELS}, {ASKED},
    w AS (SELECT p.id, term, tf / greatest(dl, 1) * (ln((n + 1) / (df + 1)) + 1) AS w FROM p JOIN df USING (term) JOIN dl USING (id) CROSS JOIN s),
    cn AS (SELECT id, sqrt(sum(w * w)) AS cn FROM w GROUP BY id),
    qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({TOK.format("query")}) AS term FROM a) GROUP BY ALL),
    ql AS (SELECT qid, sum(tf) AS ql FROM qt GROUP BY qid),
    qw AS (SELECT qid, term, tf / ql * coalesce(ln((n + 1) / (df + 1)) + 1, 1.0) AS wq FROM qt JOIN ql USING (qid) LEFT JOIN df USING (term) CROSS JOIN s),
    qn AS (SELECT qid, sqrt(sum(wq * wq)) AS qn FROM qw GROUP BY qid)"""
    return ctes, "SELECT qid, id, sum(wq * w) / (any_value(qn) * any_value(cn)) AS score FROM qw JOIN w USING (term) JOIN qn USING (qid) JOIN cn USING (id) GROUP BY qid, id"


def _only(scored: str) -> str:
    return f"SELECT * FROM ({scored}) WHERE id IN (SELECT id FROM c WHERE {WHERE})"


def _cosine(where: str = "true", k: int = 10, method: str = "semantic") -> str:
    scored = f"""SELECT a.vec_id AS qid, b.vec_id AS id,
    list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-10) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND len(a.embedding) > 0 AND len(b.embedding) > 0 AND {where}"""
    return _ranked(scored, k, method)


BUCKET = "('0x' || substr(md5(term), 1, 8))::BIGINT % 128"


def _bag_scores() -> str:
    """CTE ds(qid, id, score): dense leg over bags of words."""
    return f"""cb AS (SELECT id, {BUCKET} AS b, sum(tf) AS x FROM p GROUP BY ALL), qb AS (SELECT qid, {BUCKET} AS b, sum(tf) AS x FROM qt GROUP BY ALL),
    cl AS (SELECT c.id, coalesce(sqrt(sum(x * x)), 0) AS l FROM c LEFT JOIN cb USING (id) GROUP BY c.id), qlen AS (SELECT qid, sqrt(sum(x * x)) AS l FROM qb GROUP BY qid),
    dots AS (SELECT qid, id, sum(qb.x * cb.x) AS d FROM qb JOIN cb USING (b) GROUP BY qid, id),
    ds AS (SELECT qlen.qid, cl.id, coalesce(d, 0) / (qlen.l * cl.l + 1e-10) AS score FROM qlen CROSS JOIN cl LEFT JOIN dots ON dots.qid = qlen.qid AND dots.id = cl.id)"""


def _metrics(k: int, empty_recall: str = "1.0") -> str:
    """CTE m(qid, recall, precision, hit, mrr, ndcg)."""
    return f"""WITH {CHUNKS}, {QRELS}, {RESULTS},
    nd AS (SELECT qid, [x FOR x IN coalesce(gold_needles, []) IF x IS NOT NULL AND x <> ''] AS needles FROM q),
    v AS (SELECT nd.qid, needles, rank, [x FOR x IN needles IF contains(lower(coalesce(content, '')), lower(x))] AS cov FROM nd LEFT JOIN r USING (qid)),
    v2 AS (SELECT *, CASE WHEN rank IS NULL THEN 0 WHEN len(cov) > 0 THEN 1 ELSE 0 END AS rel, coalesce(rank <= {k}, false) AS inn FROM v),
    g AS (SELECT qid, any_value(needles) AS needles, sum(CASE WHEN inn THEN rel ELSE 0 END) AS nrel, min(CASE WHEN inn AND rel = 1 THEN rank END) AS fr,
        sum(CASE WHEN inn AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel) AS allrel, len(list_distinct(flatten(list(CASE WHEN inn THEN cov ELSE [] END)))) AS ncov FROM v2 GROUP BY qid),
    m AS (SELECT qid, CASE WHEN len(needles) = 0 THEN {empty_recall} ELSE least(1.0, ncov / len(needles)) END AS recall,
        CASE WHEN len(needles) = 0 THEN 0.0 ELSE nrel / {k} END AS precision, CASE WHEN nrel > 0 THEN 1.0 ELSE 0.0 END AS hit,
        CASE WHEN fr IS NULL THEN 0.0 ELSE 1.0 / fr END AS mrr,
        CASE WHEN allrel = 0 THEN 0.0 ELSE least(1.0, dcg / list_sum([1 / log2(i + 1) FOR i IN range(1, least(allrel, {k})::BIGINT + 1)])) END AS ndcg FROM g)"""


def _long() -> str:
    return "long AS (SELECT qid, name, value FROM m UNPIVOT (value FOR name IN (recall, precision, hit, mrr, ndcg)))"


def _native() -> str:
    b = 2000
    low, high = int((1 - 0.95) / 2 * b) + 1, int((1 - (1 - 0.95) / 2) * b)
    return f"""lg AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY qid) - 1 AS i FROM long),
    cnt AS (SELECT name, count(*) AS n, avg(value) AS mean FROM lg GROUP BY name),
    dr AS (SELECT n, b, ('0x' || substr(md5(concat_ws('|', 42, b, j)), 1, 8))::BIGINT % n AS i FROM (SELECT DISTINCT n FROM cnt), range({b}) rb(b), LATERAL (SELECT unnest(range(n)) AS j)),
    ms AS (SELECT name, b, sum(value) / any_value(n) AS m FROM (SELECT lg.*, n FROM lg JOIN cnt USING (name)) JOIN dr USING (n, i) GROUP BY name, b),
    pl AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY m, b) AS p FROM ms),
    summary AS (SELECT name, any_value(mean) AS mean, max(CASE WHEN p = {low} THEN m END) AS ci_low, max(CASE WHEN p = {high} THEN m END) AS ci_high, any_value(n) AS n FROM pl JOIN cnt USING (name) GROUP BY name)"""


def _context(separator: str, position: str, empty: str) -> str:
    return f"""ctx AS (SELECT qid, string_agg('[' || {position} || '] [Source: ' || coalesce(source, doc_id) || ']' || chr(10) || coalesce(content, ''), {separator} ORDER BY {position}) AS context FROM kept GROUP BY qid)
    SELECT q.qid, coalesce(context, {empty}) AS context FROM q LEFT JOIN ctx USING (qid)"""


def _windows(units: str, size: int) -> str:
    """CTEs over units(doc_id, u, text): pieces(doc_id, u, a, piece), cut as the windows of `size` are, 50 shared."""
    white = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
    reach = f"substr(text, a + 1, {size})"
    stop, line = rf"length(regexp_extract({reach}, '(?s)^(.*)\. ', 1))", rf"length(regexp_extract({reach}, '(?s)^(.*)\n', 1))"
    end = f"CASE WHEN a + {size} >= length(text) THEN length(text) WHEN {stop} > 0 THEN a + {stop} + 1 WHEN {line} > 0 THEN a + {line} ELSE a + {size} END"
    return f"""units AS ({units}), win AS (SELECT doc_id, u, text, 0 AS a, (SELECT {end.replace('a +', '0 +')}) AS e FROM (SELECT *, 0 AS a FROM units) WHERE length(text) > {size}
    UNION ALL SELECT doc_id, u, text, a, {end} AS e FROM (SELECT doc_id, u, text, CASE WHEN e - 50 > a THEN e - 50 ELSE e END AS a FROM win) WHERE a < length(text)),
    pieces AS (SELECT doc_id, u, 0 AS a, text AS piece FROM units WHERE length(text) <= {size} AND text <> ''
    UNION ALL SELECT doc_id, u, a, regexp_replace(substr(text, a + 1, e - a), '^{white}+|{white}+$', '', 'g') FROM win)
    SELECT doc_id || '_c' || i AS id, doc_id, piece AS content, i::INTEGER AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u, a) - 1 AS i FROM pieces WHERE piece <> '')"""


KEPT = """kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM
    (SELECT *, row_number() OVER (PARTITION BY qid, content ORDER BY rank) AS f FROM r WHERE {}) WHERE f = 1)"""
DOCS = "d AS (SELECT doc_id, any_value(content) AS content, any_value(source) AS source, any_value(ord) AS ord FROM kb_documents GROUP BY doc_id)"


def oracle_sql() -> dict[str, str]:
    out = {}
    out["tokenize_tf"] = f"WITH {_index()} SELECT id, term, tf FROM p"
    out["doc_freq"] = f"WITH {_index()} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf_bm25, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf_tfidf FROM df CROSS JOIN s"
    out["corpus_stats"] = f"WITH {_index()} SELECT n, round(avgdl, 6) AS avgdl FROM s"
    ctes, scored = _bm25_scores()
    bm25 = ctes
    out["bm25_topk"] = f"{ctes} {_ranked(scored, 10, 'bm25')}"
    out["bm25_filtered_topk"] = f"{ctes} {_ranked(_only(scored), 10, 'bm25')}"
    ctes, s = _bm25_scores(True)
    out["bm25_stopwords_topk"] = f"{ctes.replace(ASKED, ASKED_ALL)} {_ranked(s, 10, 'bm25')}"
    t = TOK.format("query")
    ctes, s = _bm25_scores(terms=f"list_concat({t}, flatten([CASE x WHEN 'parcel' THEN ['package', 'plates'] WHEN 'manual' THEN ['notebook'] ELSE [] END FOR x IN {t}]))")
    out["bm25_synonyms_topk"] = f"{ctes} {_ranked(s, 10, 'bm25')}"
    kw, ks = _keyword_scores()
    out["keyword_topk"] = f"{kw} {_ranked(ks, 10, 'keyword')}"
    out["keyword_filtered_topk"] = f"{kw} {_ranked(_only(ks), 10, 'keyword')}"
    out["cosine_topk"] = _cosine()
    out["cosine_filtered_topk"] = _cosine("b.label < 3")
    out["vectorstore_topk"] = _cosine(k=5, method="vectorstore:memory")
    legs = f"{kw}, {_bag_scores()}, kl AS ({_ranked(ks, 30, 'keyword')}), sl AS ({_ranked('SELECT * FROM ds', 30, 'semantic')})"
    out["hybrid_rrf_topk"] = f"""{legs}, f AS (SELECT qid, id, kl.rank AS ra, sl.rank AS rb, coalesce(1.0 / (60 + kl.rank), 0) + coalesce(1.0 / (60 + sl.rank), 0) AS score FROM kl FULL JOIN sl USING (qid, id))
    SELECT qid, rank, id, round(score, 6) AS score, 'hybrid' AS retrieval_method FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, ra NULLS LAST, rb NULLS LAST, id) AS rank FROM f) WHERE rank <= 10"""
    dense = _ranked("SELECT * FROM ds WHERE qid % 100 = 0", 10, "semantic")
    lexical = _ranked(f"SELECT * FROM ({ks}) WHERE qid % 100 <> 0", 10, "semantic (fallback to keyword)")
    out["semantic_fallback_topk"] = f"{kw}, {_bag_scores()} ({dense}) UNION ALL ({lexical})"
    rr = f"""{bm25}, base AS ({_ranked(scored, 15, 'bm25')}), qw AS (SELECT qid, list_distinct({TOK.format('query')}) AS qw FROM a),
    rs AS (SELECT qid, id, rank AS br, CASE WHEN len(qw) = 0 THEN 0.0 ELSE len(list_intersect(qw, terms)) / len(qw) END AS score FROM base JOIN qw USING (qid) JOIN t USING (id)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, br) AS rank FROM rs)"""
    out["rerank_overlap_topk"] = f"{rr.replace(ASKED, ASKED_ALL)} SELECT qid, rank, id, round(score, 6) AS score, 'rerank:mock(bm25)' AS retrieval_method FROM rk WHERE rank <= 5"
    out["rerank_threshold_topk"] = f"""{rr}, ok AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, id, round(score, 6) AS score, 'rerank:mock(bm25)' AS retrieval_method FROM rk WHERE rank <= 5 AND score >= 0.8)
    SELECT * FROM ok UNION ALL SELECT qid, rank, id, score, retrieval_method FROM base WHERE rank <= 5 AND qid NOT IN (SELECT qid FROM ok)"""
    keep = f"[x FOR x IN {TOK.format('query')} IF NOT list_contains({_list(FILLERS)}, x)]"
    out["rule_rewrite"] = f"""WITH {QRELS} SELECT qid, query AS query_original, CASE WHEN len({keep}) > 0 THEN array_to_string({keep}, ' ') ELSE trim(regexp_replace(query, '\\s+', ' ', 'g')) END AS query_effective, 'rule' AS rewrite_method FROM q WHERE query IS NOT NULL"""
    tests = {"equal": "lang = 'de'", "missing": "source IS NULL", "range": "chunk_index > 1 AND chunk_index <= 7", "in_with_none": "source_format = 'pdf' OR source_format IS NULL", "across_types": "false", "unknown_operator": "false", "empty": "true", "conjunction": WHERE}
    out["filter_predicates"] = f"WITH {CHUNKS} " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER ({w}) AS passed FROM c" for n, w in tests.items())
    out["metrics_per_query"] = f"{_metrics(5)} SELECT qid, round(recall, 6) AS recall, round(precision, 6) AS precision, round(hit, 6) AS hit, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM m"
    out["metric_means"] = f"{_metrics(5)}, {_long()} SELECT name, round_even(avg(value), 3) AS mean, count(*) AS n FROM long GROUP BY name"
    out["scorer_recall"] = f"{_metrics(3, '0.0')} SELECT qid, round_even(recall, 3) AS value FROM m"
    out["bootstrap_native"] = f"{_metrics(5)}, {_long()}, {_native()} SELECT name, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM summary"
    dims = " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{m}' AS name, {t}::DOUBLE AS threshold, {w}::DOUBLE AS weight" for d, m, t, w in RUBRIC)
    out["rubric_dimensions"] = f"""{_metrics(5)}, {_long()}, {_native()} SELECT dimension, CASE WHEN ci_low IS NULL THEN 'NA' WHEN round_even(ci_low, 3) >= threshold THEN 'PASS' ELSE 'FAIL' END AS status, threshold, weight
    FROM ({dims}) LEFT JOIN summary USING (name)"""
    out["cited_context"] = f"WITH {CHUNKS}, {QRELS}, {RESULTS}, {KEPT.format('score >= 0.2')}, {_context('chr(10) || ' + repr('---') + ' || chr(10)', 'pos', repr(EMPTY))}"
    out["evaluation_context"] = f"WITH {CHUNKS}, {QRELS}, {RESULTS}, kept AS (SELECT * FROM r), {_context('chr(10) || chr(10)', 'rank', repr(NO_CONTEXT))}"
    ctx = _context("chr(10) || '---' || chr(10)", "pos", "NULL")
    out["augmented_message"] = f"""WITH {CHUNKS}, {QRELS}, {RESULTS}, {KEPT.format('score >= 0.2')}, x AS (WITH {ctx})
    SELECT qid, CASE WHEN context IS NULL THEN query ELSE 'Document context:' || chr(10) || '---' || chr(10) || context || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || query END AS message FROM q JOIN x USING (qid) WHERE query IS NOT NULL"""
    out["context_dedupe"] = f"WITH {CHUNKS}, {RESULTS}, {KEPT.format('true')} SELECT qid, pos AS position, rank, id FROM kept"
    numbers, names = r"regexp_extract_all(coalesce(answer, ''), '\[(\d+)\]', 1)", r"[trim(x) FOR x IN regexp_extract_all(coalesce(answer, ''), '(?i)\[Source:\s*([^\]]+)\]', 1)]"
    out["citation_precision"] = f"""WITH {ANSWERS}, z AS (SELECT qid, {numbers} AS nu, {names} AS na, [x.source FOR x IN coalesce(retrieved, [])] AS src FROM w)
    SELECT qid, round(CASE WHEN len(nu) + len(na) = 0 THEN 1.0 ELSE (len([x FOR x IN nu IF try_cast(x AS BIGINT) BETWEEN 1 AND len(src)]) + len([x FOR x IN na IF list_contains(src, x)])) / (len(nu) + len(na)) END, 6) AS value FROM z"""
    norm = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\s]', '', 'g'))"
    tok = "list_distinct([x FOR x IN string_split_regex({}, '\\s+') IF x <> ''])"
    out["answer_correctness"] = f"""WITH {ANSWERS}, n AS (SELECT qid, answer, expected, {norm.format('answer')} AS a, {norm.format('expected')} AS e FROM w),
    o AS (SELECT *, CASE WHEN e = '' THEN 1.0 WHEN contains(a, e) THEN 1.0 ELSE len(list_intersect({tok.format('a')}, {tok.format('e')})) / greatest(len([x FOR x IN string_split_regex(e, '\\s+') IF x <> '']), 1) END AS v FROM n)
    SELECT qid, round(v, 6) AS overlap, round(CASE WHEN coalesce(expected, '') = '' THEN 1.0 WHEN trim(coalesce(answer, '')) = '' THEN 0.0 ELSE v END, 6) AS score FROM o"""
    out["abstention"] = f"WITH {ANSWERS} SELECT qid, CASE WHEN NOT coalesce(oos, false) THEN 1.0 WHEN len([x FOR x IN {_list(REFUSALS)} IF contains(lower(coalesce(answer, '')), x)]) > 0 THEN 1.0 ELSE 0.0 END AS value FROM w"
    up = "upper(coalesce(answer, ''))"
    out["answer_scalars"] = f"""WITH {ANSWERS} SELECT qid, CASE WHEN contains({up}, 'UNSUPPORTED') THEN 'UNSUPPORTED' WHEN contains({up}, 'CONTRADICTED') THEN 'CONTRADICTED' WHEN contains({up}, 'SUPPORTED') THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict,
    round(least(1.0, coalesce(try_cast(regexp_extract(coalesce(answer, ''), '([0-9]*\\.?[0-9]+)', 1) AS DOUBLE), 0.0)), 6) AS number, {norm.format('answer')} AS normal FROM w"""
    clamped = "CASE WHEN score IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) END"
    out["score_scalars"] = f"WITH {CHUNKS}, {RESULTS} SELECT qid, rank, round(1 / (1 + exp(-score)), 6) AS logistic, round({clamped}, 6) AS clamped, round_even(round({clamped}, 6), 3) AS rounded FROM r"
    white = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
    out["sentence_chunks"] = f"""WITH {DOCS}, s AS (SELECT doc_id, [y FOR y IN [regexp_replace(x, '^{white}+|{white}+$', '', 'g') FOR x IN string_split(regexp_replace(content, '([.!?]){white}+', '\\1' || chr(1), 'g'), chr(1))] IF y <> ''] AS parts FROM d WHERE content IS NOT NULL),
    k AS (SELECT doc_id, string_split(list_reduce(parts, lambda acc, x: acc || CASE WHEN length(split_part(acc, chr(1), -1)) + 1 + length(x) > 800 THEN chr(1) ELSE ' ' END || x), chr(1)) AS chunks FROM s WHERE len(parts) > 0)
    SELECT doc_id || '_c' || (i - 1) AS id, doc_id, chunks[i] AS content, (i - 1)::INTEGER AS chunk_index FROM k, LATERAL (SELECT unnest(range(1, len(chunks) + 1)) AS i)"""
    ext = r"lower(regexp_extract(source, '(\.[^./]+)$', 1))"
    path = r"regexp_extract(source, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
    out["source_formats"] = f"""WITH {DOCS} SELECT doc_id, CASE WHEN {ext} IN ('.txt', '.md', '.markdown', '.rst', '.text') THEN 'text' WHEN {ext} IN ('.html', '.htm', '.xhtml') THEN 'html' WHEN {ext} = '.pdf' THEN 'pdf' WHEN {ext} = '.docx' THEN 'docx' ELSE 'text' END AS format,
    coalesce(nullif(split_part({path}, '/', -1), ''), 'document') AS name FROM d"""
    out["passages"] = f"""SELECT 'p' || substr(sha1(text), 1, 12) AS passage_id, min(array_to_string(([x FOR x IN string_split_regex(text, '{white}+') IF x <> ''])[1:10], ' ')) AS snippet, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"""
    strip = lambda x: f"regexp_replace({x}, '^{white}+|{white}+$', '', 'g')"
    out["fixed_chunks"] = f"WITH RECURSIVE {DOCS}, {_windows('SELECT doc_id, 0 AS u, ' + strip('content') + ' AS text FROM d WHERE content IS NOT NULL', 500)}"
    out["paragraph_chunks"] = f"""WITH RECURSIVE {DOCS}, pp AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM
    (SELECT doc_id, [y FOR y IN [{strip('x')} FOR x IN string_split(content, chr(10) || chr(10))] IF y <> ''] AS ps FROM d WHERE content IS NOT NULL)),
    hp AS (SELECT *, regexp_matches(p, '^#{{1,6}}{white}') AS h FROM pp), lp AS (SELECT *, lag(h, 1, false) OVER o AS before, lag(p) OVER o AS head, lead(h) OVER o AS after FROM hp WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    {_windows("SELECT doc_id, i AS u, CASE WHEN NOT h AND before THEN head || chr(10) || chr(10) || p ELSE p END AS text FROM lp WHERE NOT (h AND coalesce(NOT after, false))", 1000)}"""
    solid = r"trim(regexp_replace({}, '[\x09-\x0D ]+', ' ', 'g')) <> ''"
    out["parsed_text"] = f"WITH {DOCS} SELECT doc_id, doc_id || '.md' AS title, content, 'text' AS source_format FROM d WHERE strlen(content) <= 3000 AND {solid.format('content')}"
    lines = f"[y FOR y IN [{strip('x')} FOR x IN string_split(content, chr(10))] IF y <> '']"
    out["parsed_html"] = f"WITH {DOCS} SELECT doc_id, array_to_string({lines}, ' ') AS content, 'html' AS source_format FROM d WHERE content IS NOT NULL AND len({lines}) > 0"
    out["detected_formats"] = f"WITH {DOCS} SELECT doc_id, CASE WHEN ord % 4 = 0 THEN 'pdf' WHEN ord % 4 IN (1, 2) THEN 'html' ELSE 'text' END AS format FROM d WHERE content IS NOT NULL"
    out["text_tests"] = f"WITH {DOCS} SELECT doc_id, len([x FOR x IN string_split(content, chr(10)) IF regexp_matches(x, '^#{{1,6}}\\s')])::INTEGER AS headings, ord % 2 = 0 AND strlen(content) < 8192 AS binary FROM d WHERE content IS NOT NULL"
    out["needle_lists"] = f"WITH {QRELS} SELECT qid, (CASE WHEN qid % 3 = 0 THEN 0 ELSE len(coalesce(gold_needles, [])) END)::INTEGER AS n FROM q"
    words10 = lambda x: f"array_to_string(([x FOR x IN string_split_regex({x}, '{white}+') IF x <> ''])[1:10], ' ')"
    out["passage_questions"] = f"""WITH {CHUNKS}, {QRELS}, {RESULTS} SELECT qid, 'p' || substr(sha1(text), 1, 12) AS gold_doc, {words10('substr(text, 1, 200)')} AS needle
    FROM (SELECT r.qid, min_by(content, rank) AS text FROM r JOIN q USING (qid) WHERE content IS NOT NULL AND rank <= 2 GROUP BY r.qid)"""
    out["passage_ids"] = f"WITH {CHUNKS}, {QRELS}, {RESULTS} SELECT DISTINCT 'p' || substr(sha1(content), 1, 12) AS doc_id FROM r JOIN q USING (qid) WHERE content IS NOT NULL"
    out["answer_corpus_ids"] = f"""WITH {ANSWERS}, k AS (SELECT retrieved[1].content AS context FROM w WHERE answer IS NOT NULL AND len(retrieved) > 0 AND retrieved[1].content IS NOT NULL ORDER BY md5(concat_ws('|', 7, qid)), qid LIMIT 40),
    own AS (SELECT DISTINCT 'p' || substr(sha1(context), 1, 12) AS doc_id FROM k), more AS (SELECT DISTINCT 'p' || substr(sha1(text), 1, 12) AS doc_id FROM documents WHERE length(text) >= 80 AND 'p' || substr(sha1(text), 1, 12) NOT IN (SELECT doc_id FROM own))
    SELECT doc_id FROM own UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', 7, doc_id)), doc_id) AS i FROM more) WHERE i <= 300 - (SELECT count(*) FROM own)"""
    out["csv_questions"] = f"WITH {QRELS} SELECT query, array_to_string([trim(x) FOR x IN coalesce(gold_needles, []) IF x IS NOT NULL AND trim(x) <> ''], '|') AS needles, false AS out_of_scope FROM q WHERE query IS NOT NULL"
    out["embedding_bags"] = f"""WITH {_index()}, b AS (SELECT id, {BUCKET} AS b, sum(tf) AS x FROM p GROUP BY ALL), g AS (SELECT c.id, i FROM c, range(128) r(i))
    SELECT g.id, string_agg(coalesce(x, 0)::BIGINT::VARCHAR, ',' ORDER BY i) AS bag FROM g LEFT JOIN b ON b.id = g.id AND b.b = g.i GROUP BY g.id"""
    mrr = lambda s, name: f"""{name} AS (SELECT a.qid, coalesce(1.0 / min(CASE WHEN len([x FOR x IN coalesce(q.gold_needles, []) IF x IS NOT NULL AND x <> '' AND contains(lower(coalesce(c.content, '')), lower(x))]) > 0 THEN k.rank END), 0.0) AS v FROM a JOIN q USING (qid) LEFT JOIN ({_ranked(s, 10, name)}) k ON k.qid = a.qid LEFT JOIN c ON c.id = k.id GROUP BY a.qid)"""
    bq = scored.replace("FROM qt ", "FROM (SELECT DISTINCT qid, term FROM qt) ")
    out["compare_deltas"] = f"{kw.replace(ASKED, ASKED_ALL)}, {mrr(ks, 'mk')}, {mrr(bq, 'mb')} SELECT qid, round(mk.v, 6) AS keyword, round(mb.v, 6) AS bm25, round(mb.v - mk.v, 6) AS delta FROM mk JOIN mb USING (qid)"
    out["cached_bags"] = out["embedding_bags"]
    out["filter_sql"] = out["filter_predicates"]
    out["index_norms"] = f"{kw} SELECT id, round(cn, 6) AS norm FROM cn"
    out["stemmed_df"] = f"WITH {_index('id')} SELECT term, df FROM df"
    usable = "len(c.embedding) = 64 AND len([x FOR x IN c.embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN c.embedding IF x <> 0]) > 0"
    dense = "SELECT a.vec_id AS qid, c.id, list_inner_product(a.embedding::DOUBLE[], c.embedding) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(c.embedding, c.embedding)) + 1e-10) AS score FROM embeddings a, u c WHERE a.vec_id % 50 = 0 AND len(a.embedding) > 0"
    out["chunk_cosine_topk"] = f"WITH u AS (SELECT id, any_value(embedding) AS embedding FROM chunks c WHERE {usable} GROUP BY id) {_ranked(dense, 10, 'semantic')}"
    out["vectorstore_filtered_topk"] = _cosine("b.label < 3", 5, "vectorstore:faiss")
    out["vectorstore_count"] = "SELECT count(*) AS n FROM embeddings WHERE len(embedding) > 0"
    out["rerank_soft_topk"] = f"""{rr}, ts AS (SELECT qid, length(query) % 4 = 3 AS works FROM a)
    SELECT qid, rank, id, round(score, 6) AS score, 'rerank:own(bm25)' AS retrieval_method FROM rk JOIN ts USING (qid) WHERE rank <= 5 AND works
    UNION ALL SELECT qid, rank, id, score, 'rerank:failed(own,bm25)' FROM base JOIN ts USING (qid) WHERE rank <= 5 AND NOT works"""
    ctes, s = _bm25_scores(terms=f"CASE WHEN len({keep}) > 0 THEN {keep} ELSE {t} END")
    out["rewritten_topk"] = f"{ctes.replace(ASKED, ASKED_ALL)} {_ranked(s, 10, 'bm25')}"
    said = "regexp_matches(query, '^[HW]')"
    plain = f"CASE WHEN len({keep}) > 0 THEN array_to_string({keep}, ' ') ELSE trim(regexp_replace(query, '\\s+', ' ', 'g')) END"
    out["chat_rewrite"] = f"WITH {QRELS} SELECT qid, query AS query_original, CASE WHEN {said} THEN 'short form' ELSE {plain} END AS query_effective, CASE WHEN {said} THEN 'llm' ELSE 'rule-fallback' END AS rewrite_method FROM q WHERE query IS NOT NULL"
    status = "CASE WHEN ci_low IS NULL THEN 'NA' WHEN round_even(ci_low, 3) >= threshold THEN 'PASS' ELSE 'FAIL' END"
    out["rubric_decision"] = f"""{_metrics(5)}, {_long()}, {_native()}, ru AS (SELECT {status} AS status, weight, n FROM ({dims}) LEFT JOIN summary USING (name))
    SELECT coalesce(min(n) FILTER (status <> 'NA') >= {LEAST_CASES}, false) AND count(*) FILTER (status = 'FAIL') = 0 AS overall_pass,
    round(coalesce(coalesce(sum(weight) FILTER (status = 'PASS'), 0) / sum(weight) FILTER (status <> 'NA'), 0), 6) AS weighted_score, coalesce(min(n) FILTER (status <> 'NA') >= {LEAST_CASES}, false) AS min_n_ok FROM ru"""
    out["compare_interval"] = f"""{kw}, {mrr(ks, 'mk')}, {mrr(bq, 'mb')}, long AS (SELECT qid, 'mrr' AS name, mb.v - mk.v AS value FROM mk JOIN mb USING (qid)), {_native()}
    SELECT name, n, (SELECT round_even(avg(v), 3) FROM mk) AS mean_a, (SELECT round_even(avg(v), 3) FROM mb) AS mean_b, round_even(mean, 3) AS delta, round_even(ci_low, 3) AS ci_low, round_even(ci_high, 3) AS ci_high, ci_low > 0 OR ci_high < 0 AS significant FROM summary"""
    block = "'[' || rank || '] [Source: ' || coalesce(source, doc_id) || '] (score: ' || printf('%.3f', score) || ', method: ' || retrieval_method || ')' || chr(10) || coalesce(content, '')"
    out["results_markdown"] = f"WITH {CHUNKS}, {RESULTS} SELECT qid, string_agg({block}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS text FROM r WHERE score IS NOT NULL GROUP BY qid"
    told = f"'Document context:' || chr(10) || '---' || chr(10) || coalesce(context, {EMPTY!r}) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || query"
    out["turns_in_context"] = f"""WITH {CHUNKS}, {QRELS}, {RESULTS}, {KEPT.format('score >= 0.2')}, x AS (WITH {ctx})
    SELECT qid AS conv_id, turn::INTEGER AS turn, CASE turn WHEN 1 THEN 'assistant' ELSE 'user' END AS role, CASE turn WHEN 0 THEN 'Hello?' WHEN 1 THEN 'Yes?' ELSE {told} END AS text
    FROM q JOIN x USING (qid), range(3) g(turn) WHERE query IS NOT NULL"""
    out["scorer_citation"] = f"""WITH {ANSWERS}, z AS (SELECT qid, {numbers} AS nu, {names} AS na, [x.source FOR x IN coalesce(retrieved, [])][1:2] AS src FROM w)
    SELECT qid, round_even(CASE WHEN len(nu) + len(na) = 0 THEN 1.0 ELSE (len([x FOR x IN nu IF try_cast(x AS BIGINT) BETWEEN 1 AND len(src)]) + len([x FOR x IN na IF list_contains(src, x)])) / (len(nu) + len(na)) END, 3) AS value FROM z"""
    blank = lambda x: f"{strip(f'coalesce({x}, chr(32))')} = ''"
    out["judged_answers"] = out["answer_correctness"].split("SELECT qid, round(v, 6)")[0] + f"""SELECT qid, round(CASE WHEN NOT {blank('answer')} AND NOT {blank('expected')} AND contains(answer, '[1]') THEN 0.25
    WHEN coalesce(expected, '') = '' THEN 1.0 WHEN trim(coalesce(answer, '')) = '' THEN 0.0 ELSE v END, 6) AS value FROM o"""
    out["faithful_answers"] = f"""WITH {ANSWERS}, z AS (SELECT qid, answer, array_to_string([x.content FOR x IN coalesce(retrieved, []) IF x.content IS NOT NULL], chr(10)) AS context FROM w)
    SELECT qid, CASE WHEN {blank('answer')} OR {blank('context')} OR regexp_matches(context, '(?i)battery') THEN 1.0 ELSE 0.5 END AS value FROM z"""
    values = ", ".join(f"('c_{d}', '{d}', '{c}', '{d}')" for d, c in CORPUS)
    asked = ", ".join(f"({i}, '{q}', ['{n}'], false)" for i, (q, _, n) in enumerate(QUESTIONS))
    own = f"c AS (SELECT * FROM (VALUES {values}) v(id, doc_id, content, source))"
    golden = f"q AS (SELECT * FROM (VALUES {asked}) v(qid, query, gold_needles, oos)), a AS (SELECT qid, query FROM q)"
    ctes, s = _bm25_scores()
    found = f"{ctes.replace(CHUNKS, own).replace(f'{QRELS}, {ASKED}', golden)}, k AS ({_ranked(s, 10, 'bm25')}), r AS (SELECT k.qid, k.rank, k.id, c.content FROM k JOIN c USING (id)),"
    out["synthetic_eval"] = _metrics(10).replace(f"WITH {CHUNKS}, {QRELS}, {RESULTS},", found).replace("g AS (SELECT qid", "g AS (SELECT qid") + f", {_long()} SELECT name, round_even(avg(value), 3) AS mean, count(*) AS n FROM long GROUP BY name"
    return out
