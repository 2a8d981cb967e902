import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import boilerplate, bpe, ciphers, decipher, encodings, langmodel, language, leakage, nearduplicates, neighbours, pagelines, quantiser, queries, splitting, tokenize

VOCABULARY = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


# ---- p6


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return bpe.PrefixEncoder(bpe.read_ranks(f.read()))


@pytest.fixture(scope="module")
def public():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeth sn'tA1½ä \n\t  界🧭\\|<>"), max_size=80))
def test_ids_equal_the_public_encoder(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)


def test_ids_of_odd_texts(encoder, public):
    for text in ["a" * 3000, "<|endoftext|> it's", " " * 9 + "q", "x  y \n", "\0\x7f", "it's we'll I'd", "日本語" * 50]:
        assert encoder.encode(text) == public.encode_ordinary(text)


def test_encode_texts(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "hello <|endoftext|>"), (4, "hello <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    out = tokenize.encode_texts(df, "doc_id", "text", VOCABULARY).collect()
    assert len(out) == 5 and {r.doc_id for r in out if r.ids == []} == {1, 2}
    assert tokenize.encode_texts(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0


# ---- p2


def shingle_pairs(rows, t, n=3, least=40):
    sets = {}
    for i, x in rows:
        words = re.findall(r"\w+", (x or "").lower())
        if i is not None and len(words) >= least:
            sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def edited(rng, words, share):
    return [rng.choice("alpha beta gamma delta".split()) if rng.random() < share else w for w in words]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([41, 60, 130, 260]))]
        rows += [(f"g{g}_{k}", " ".join(edited(rng, base, rng.choice([0, 0.02, 0.1, 0.15])))) for k in range(6)]
    rows += [("none", None), ("empty", ""), ("short", "a b c"), (None, rows[0][1]), rows[0], ("copy", rows[0][1]), ("copy2", rows[0][1].upper())]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "'x' AS key", "1 AS similarity", "2 AS place")
    got = nearduplicates.near_duplicate_pairs(df, "id", "content", 0.5).collect()
    pairs = [(r.id_a, r.id_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == shingle_pairs(rows, 0.5)
    groups = {r.id: r for r in nearduplicates.near_duplicate_groups(df, "id", "content", 0.5).collect()}
    assert all(groups[a].group_id == groups[b].group_id for a, b in pairs)
    assert {i for i, r in groups.items() if r.group_id is not None} == {i for i, x in rows if i and x and len(x.split()) >= 40}
    assert set(groups) == {i for i, _ in rows if i} and all(r.links == 0 for r in groups.values() if r.group_id is None)
    assert nearduplicates.near_duplicate_pairs(df.limit(0), "id", "content", 0.5).count() == 0


def test_hot_lists_are_dealt_in_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nearduplicates, "HOT", 3)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(50)]
    texts = [" ".join(edited(rng, base, 0.05)) for _ in range(40)]
    count = np.zeros(1 << nearduplicates.SKETCH_BITS, np.uint32)
    _, _, h = nearduplicates.batch_sets(texts, 3, 40)
    np.add.at(count, nearduplicates.bucket(h), 1)
    rarity = np.where(count < 2, count, 2 + 8 * np.log2(np.maximum(count, 2) / 2)).clip(0, 255).astype(np.uint8)
    parts: dict = {}
    for p, *blobs in nearduplicates.prefix_fragments(texts, rarity, 3, 40, 0.5, 4):
        for k, b in enumerate(blobs):
            parts.setdefault(p, {}).setdefault(k, []).append(b)
    shared: dict = {}
    for own in parts.values():
        pairs, counts = nearduplicates.meeting_pairs(own[0], own[1], own[2], 0.5)
        for a, b, m, n, c in zip(*pairs.T.tolist(), counts.tolist()):
            shared[a, b] = (m, n, shared.get((a, b), (m, n, 0))[2] + c)
    rest = lambda m, n: max(math.ceil(min(m, n) * 2 / 3 - 1e-9), math.ceil(max(m, n) / 2 - 1e-9)) - 1
    met = {k for k, (m, n, c) in shared.items() if c + rest(m, n) >= math.ceil((m + n) / 3 - 1e-9)}
    key = {f"{i}": nearduplicates.text_key(nearduplicates.tokens(x)) for i, x in enumerate(texts)}
    want = {tuple(sorted((key[a], key[b]))) for a, b in shingle_pairs([(str(i), x) for i, x in enumerate(texts)], 0.5) if key[a] != key[b]}
    assert want <= met


def test_key_filter_passes_every_key(spark):
    pairs = spark.createDataFrame([(-5, 7), (2**62, -(2**60)), (7, 99)], "key_a long, key_b long")
    marks = nearduplicates.key_filter(pairs)
    assert all(marks[k & (len(marks) - 1)] for k in (-5, 7, 99, 2**62, -(2**60))) and marks.sum() <= 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.key: r.root for r in nearduplicates.components(edges, "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# ---- p7


def test_leakage_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(8)] + [(90, None), (91, "too short"), (0, None)]
    docs = [(None, "x"), (1, None), (2, ""), (3, items[0][1]), (3, items[0][1])]
    for k in range(60):
        item = rng.choice(items[:8])[1].split()
        a, n = rng.randrange(0, 18), rng.choice([8, 11, 12, 13])
        filler = [rng.choice(words) for _ in range(10)]
        docs.append((10 + k, " ".join(filler + item[a : a + n] + filler)))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS distance")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaked_passages(d, i, "doc_id", "text", "item_id", "text").collect()}
    grams = {}
    for k, x in items:
        w = (x or "").split()
        for a in range(len(w) - 11):
            grams.setdefault(tuple(w[a : a + 12]), set()).add(k)
    want = {(k, m) for k, x in docs for a in range(len((x or "").split()) - 11) for m in grams.get(tuple(x.split()[a : a + 12]), ())}
    assert {p for p, r in got.items() if r.longest_run >= 12} == want and len(want) > 10
    assert leakage.leaked_passages(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_one_edit_is_found_and_two_are_not():
    rng = random.Random(1)
    item = [f"v{rng.randrange(1000)}" for _ in range(12)]
    index = leakage.PassageIndex([(7, " ".join(item))], 12, 1)
    for k in range(1, 11):
        for changed in (item[:k] + ["x"] + item[k + 1 :], item[:k] + item[k + 1 :], item[:k] + ["x"] + item[k:]):
            doc, it, dist, run = index.match(["pad " + " ".join(changed) + " pad"])
            assert (doc.tolist(), dist.tolist()) == ([0], [1])
    twice = item[:3] + ["x"] + item[4:8] + ["y"] + item[9:]
    assert not len(index.match([" ".join(twice)])[0])


def edit_distance(a, b):
    """To any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=20), st.lists(st.integers(1, 4), min_size=1, max_size=25))
def test_bit_parallel_distance(pattern, text):
    assert leakage.myers(np.array([pattern]), np.array([text]))[0] == edit_distance(pattern, text)


def test_normal_words():
    assert leakage.normal_words("Ｆｕｌｌ\u00adwidth co-\noperate, A\u200bB x-y İ") == ["fullwidth", "cooperate", "ab", "x", "y", "i"]


# ---- p8


@pytest.fixture(scope="module")
def language_model(spark, data):
    return language.fit_model(spark.read.parquet(f"{data}/lang_samples.parquet"))


def test_model_is_right_on_held_out_samples(language_model, spark, data):
    assert language_model.held_out[1] > 0.95
    rows = spark.read.parquet(f"{data}/lang_samples.parquet").collect()
    judged = language.judge(language_model, [r.text for r in rows])
    assert sum(j[0] == r.lang for j, r in zip(judged, rows)) / len(rows) > 0.98


def test_language_cases(spark, language_model):
    english = "The harbour office stores the holiday calendar and the visitor badge.\nThe tutor lists every citation after the audit."
    german = "Das Handbuch beschreibt die Messwerte und das Gästebuch seit dem Frühjahr."
    rows = [(1, english, "en"), (2, english, " EN-gb "), (3, english, "english"), (4, english, None), (5, english, "de"), (6, english, "??"), (7, None, "en"), (8, "  \n", None), (9, "42 %", None), (10, english + "\n" + german, "eng")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS _label", "2 AS line_no")
    out = language.language_cases(language.assign_languages(df, "doc_id", "text", "lang", language_model), "doc_id").collect()
    assert sorted((r.doc_id, r.line_no, r.lang) for r in out) == [(4, -1, "en"), (5, -1, "en"), (6, -1, "en"), (10, 2, "de")]
    assert language.assign_languages(df.limit(0), "doc_id", "text", "lang", language_model).count() == 0


def test_no_samples(spark):
    with pytest.raises(ValueError):
        language.fit_model(spark.createDataFrame([], "text string, lang string"))
    assert len(langmodel.subwords("ab", 64)) > 2


def test_long_texts_take_the_same_ids(encoder, public):
    text = "wörter und 12 界 it's  \n" * 9000
    assert len(text) > 200_000 and encoder.encode(text) == public.encode_ordinary(text)


# ---- p4


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc. \n界!"), max_size=400), st.sampled_from([40, 64, 1000]))
def test_pieces_make_up_the_text(text, width):
    cut = splitting.pieces(text, 40, 10, width)
    stripped = text.strip()
    if not stripped:
        return
    begin = len(text) - len(text.lstrip())
    assert cut[0][0] == begin and cut[-1][1] == begin + len(stripped)
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert b - a <= 40 and b - 10 <= c <= b and a < c and d > b
    assert all(b - a <= 40 for a, b in cut)
    if len(stripped) <= 40:
        assert len(cut) == 1
    assert splitting.WHITE == "".join(c for c in map(chr, range(0x110000)) if c.isspace()) or width != 40


def split(df, width=1 << 18):
    ranges = splitting.oversized_ranges(df, "id", "content", 1000, "chunk", width=width)
    return splitting.split_items(splitting.cut_ranges(ranges, width=width)).orderBy("item_id", "piece_no").collect()


@pytest.mark.parametrize("width", [1000, 1 << 18])
def test_oversized_and_split(spark, width):
    word = "word " * 400
    rows = [("a", " " + "x" * 1000 + "  "), ("b", "\u2003" + word), ("b", "\u2003" + word), ("c", None), ("d", "　" * 3000), ("e", ""), (None, word), ("f", word * 20 + "\x1c")]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "'q' AS item_id", "1 AS k", "2 AS body")
    cut = split(df, width)
    assert {r.item_id for r in cut} == {"b", "f"}
    for i, text in (("b", rows[1][1]), ("f", rows[-1][1])):
        own = [r for r in cut if r.item_id == i]
        assert [r.piece_no for r in own] == list(range(len(own)))
        assert [(r.start, r.stop) for r in own] == splitting.pieces(text, 1000, 50, width)
        assert all(text[r.start : r.stop] == r.content and len(r.content) <= 1000 for r in own)
        assert "".join(r.content[(own[n - 1].stop - r.start if n else 0) :] for n, r in enumerate(own)) == text.strip()
    assert split(df.limit(0)) == []


def test_one_giant_row_is_cut_in_many_ranges(spark):
    rng = random.Random(9)
    text = "".join(rng.choice(["wörter ", "界面。", "line\n", "end. ", "\n\n", "x" * 70]) for _ in range(300_000))
    own = split(spark.createDataFrame([("g", text)], "id string, content string"))
    assert len(text) > 4 << 20 and own[-1].stop == len(text.rstrip())
    assert all(len(r.content) <= 1000 for r in own) and [r.piece_no for r in own] == list(range(len(own)))
    assert all(0 <= a.stop - b.start <= 50 and b.stop > a.stop for a, b in zip(own, own[1:]))


def test_running_totals(spark):
    df = spark.range(50).selectExpr("id AS k", "id * 3 % 7 AS n")
    got = {r.k: r.n_before for r in splitting.running_totals(df, 50, "k", ["n"], block=4).collect()}
    assert got == {k: sum(i * 3 % 7 for i in range(k)) for k in range(50)}


@pytest.mark.parametrize("range_bytes", [700, 5000, 1 << 20])
def test_split_file(spark, tmp_path, range_bytes):
    rng = random.Random(4)
    text = "".join(rng.choice(["wörter ", "界面。", "line\n", "end. ", "\n\n", "🧭", "x" * 70]) for _ in range(1500))
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    cut = splitting.split_file(spark, str(path), 200, 20, range_bytes).orderBy("piece_no").collect()
    assert [r.piece_no for r in cut] == list(range(len(cut)))
    assert all(text[r.start : r.stop] == r.content and len(r.content) <= 200 for r in cut)
    assert cut[0].start == 0 and cut[-1].stop == len(text)
    assert all(b.start <= a.stop <= b.start + 20 and b.stop > a.stop for a, b in zip(cut, cut[1:]))


# ---- p5


def clusters(rng, groups, each, dim=64):
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c + 0.25 * rng.normal(size=(each, dim)) for c in centres])


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    x = np.round(clusters(rng, 60, 20), 4)
    rows = [(f"v{k:04d}", v.tolist()) for k, v in enumerate(x)]
    odd = [("n1", None), ("n2", []), ("n3", [1.0] * 63), ("n4", [0.0] * 64), ("n5", [float("nan")] * 64), ("n6", [None] * 64), (None, x[0].tolist()), rows[0]]
    df = spark.createDataFrame(rows + odd, "id string, embedding array<double>").selectExpr("*", "'z' AS v")
    got: dict = {}
    for r in neighbours.nearest(df, "id", "embedding", cell_size=200).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.cosine))
    assert len(got) == len(rows) and all(len(g) == 5 for g in got.values())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    hit = sum(f"v{j:04d}" in {n for _, n, _ in got[f"v{i:04d}"]} for i in range(len(x)) for j in best[i])
    assert hit / best.size >= 0.9
    assert all(abs(c - s[int(i[1:]), int(n[1:])]) < 1e-9 for i, g in got.items() for _, n, c in g)
    assert neighbours.nearest(df.limit(0), "id", "embedding").count() == 0


def test_copies_rank_by_smaller_id(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=64)
    rows = [(f"c{k:02d}", (v * (1 + k % 2)).tolist()) for k in range(12)] + [("z", (-v).tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "id string, embedding array<double>"), "id", "embedding").collect()
    near = {i: [r.neighbour for r in sorted(got, key=lambda r: r["rank"]) if r.id == i] for i in ("c00", "c11")}
    assert near == {"c00": ["c01", "c02", "c03", "c04", "c05"], "c11": ["c00", "c01", "c02", "c03", "c04"]}


def test_rows_given_twice_cost_no_neighbour(spark):
    x = np.random.default_rng(3).normal(size=(40, 64))
    rows = [(f"d{k:02d}", v.tolist()) for k, v in enumerate(x) for _ in range(2)]
    got = neighbours.nearest(spark.createDataFrame(rows, "id string, embedding array<double>").coalesce(1), "id", "embedding").collect()
    near: dict = {}
    for r in got:
        near.setdefault(r.id, set()).add(r.neighbour)
    assert len(got) == 200 and len(near) == 40 and all(len(n) == 5 for n in near.values())


def test_cells_in_blocks_and_fine_cells_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(clusters(rng, 20, 30), 4)
    monkeypatch.setattr(quantiser.CellIndex, "BLOCK_WORK", 20_000)
    df = spark.createDataFrame([(f"v{k:04d}", v.tolist()) for k, v in enumerate(x)], "id string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = {(f"v{i:04d}", f"v{j:04d}") for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:5]}
    for coarse in (4096, 4):
        monkeypatch.setattr(quantiser.CellIndex, "COARSE", coarse)
        got = {(r.id, r.neighbour) for r in neighbours.nearest(df, "id", "embedding", cell_size=60).collect()}
        assert len(got & best) >= 0.9 * len(best)


def test_table_scan_is_the_product_with_the_decoded_codes():
    rng = np.random.default_rng(6)
    x = clusters(rng, 12, 60).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = quantiser.CellIndex(x, len(x), 120, 2, 0.6)
    cells, codes = index.place(x)
    mine = np.flatnonzero(cells[:, 0] == cells[0, 0])
    score, low, scale = index.scan(int(cells[0, 0]), x[:50], codes[mine, 0])
    packed = codes[mine, 0]
    plain = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(mine), -1)
    want = x[:50] @ (index.codes.decode(plain) + index.centre(cells[0, 0])).T
    assert codes.dtype == np.uint8 and codes.shape[2] == 16
    assert np.abs(score / scale[:, None] + low[:, None] - want).max() < 1e-3


def test_score_aware_codes_keep_large_products():
    rng = np.random.default_rng(2)
    x = clusters(rng, 20, 50).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aware, plain = (quantiser.ScoreAwareCodes(64, t).fit(x, x) for t in (0.6, 0.125))
    parallel = [abs(((x - c.decode(c.encode(x, x))) * x).sum(1)).mean() for c in (aware, plain)]
    assert parallel[0] < parallel[1]
    assert aware.encode(x, x).max() < 16


@given(st.lists(st.floats(-3, 3), min_size=64, max_size=64))
@settings(max_examples=40, deadline=None)
def test_packing_loses_nothing(values):
    for x in (np.array([values]), np.round(np.array([values]), 4)):
        assert np.array_equal(neighbours.unpack(pa.array(neighbours.pack(x), pa.binary()), 64), x)


# ---- p1


def test_a_table_that_no_code_page_has_is_learnt(spark, data):
    """A source's own substitution of its high letters is found, and undone, by its table alone."""
    samples = spark.read.parquet(f"{data}/lang_samples.parquet")
    own = dict(zip("äöüßÄÖÜ", "ħŧŋĸĦŦŊ"))
    texts = [r.text for r in samples.collect() if r.lang == "de"]
    meant = {f"odd{i}": "\n".join(texts[i * 3 : i * 3 + 3]) for i in range(8)}
    rows = [(f"ok{i}", r.text, f"https://site{i % 5}.example/x") for i, r in enumerate(samples.collect())]
    rows += [(i, t.translate(str.maketrans(own)), "https://odd.example/x") for i, t in meant.items()]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string")
    model = encodings.fit_letter_pairs(df, "content", samples)
    wrong, tables = encodings.wrong_readings(df, "doc_id", "content", "source", model)
    found = {r.id: r.swap for r in wrong.collect()}
    assert {i for i, s in found.items() if s == "learnt"} == set(meant)
    whole = {r.id: r.content for r in encodings.restored(df, "doc_id", "content", wrong, tables, model).collect()}
    right = sum(a == b for i, t in meant.items() for a, b in zip(whole[i], t) if b > "\x7f") / sum(b > "\x7f" for t in meant.values() for b in t)
    assert right >= 0.95


def test_expectation_prefers_the_letters_the_language_has(spark, data):
    samples = spark.read.parquet(f"{data}/lang_samples.parquet")
    model = encodings.fit_letter_pairs(samples.withColumn("content", F.col("text")), "content", samples)
    lang = model.languages.index("de")
    channel = decipher.Channel(model, "learnt", [])
    (symbol, letters, p), = channel.expect(lang, "f", "ŋ", "r")[0]
    assert symbol == "ŋ" and letters[int(p.argmax())] in "üö" and abs(p.sum() - 1) < 1e-9
    prior = decipher.Channel(model, "cp1252>mac-roman", []).prior("Š", lang)
    assert max(prior, key=prior.get) == ciphers.readings("Š")["cp1252>mac-roman"].lower() and abs(sum(prior.values()) - 1) < 1e-9


def test_wrong_readings(spark, data):
    samples = spark.read.parquet(f"{data}/lang_samples.parquet")
    clean = [r for r in samples.collect()]
    by = {lang: [r.text for r in clean if r.lang == lang] for lang in ("de", "ru", "fr", "pl", "en")}
    rows = [(f"ok{i}", r.text, "file:///a") for i, r in enumerate(clean)]
    broken = {
        "utf8": (by["de"][0] + "\n" + by["de"][1], "utf-8", "cp1252"),
        "koi": (by["ru"][0], "cp1251", "koi8-r"),
        "mac": (by["fr"][0] + "\n" + by["fr"][2] + "\n" + by["fr"][3], "cp1252", "mac-roman"),
        "polish": (by["pl"][0] + "\n" + by["pl"][1], "cp1250", "cp1252"),
    }
    hurt = {}
    for name, (text, meant, read) in broken.items():
        keep = "".join(c for c in text if c.encode(meant, "ignore"))
        try:
            hurt[name] = (keep, keep.encode(meant).decode(read))
        except UnicodeError:
            hurt[name] = (keep, keep.encode(meant).decode("latin-1"))
    rows += [(n, b, f"https://{n}.example/x") for n, (_, b) in hurt.items()]
    rows += [("lost", "Die B�cher und ?ber", None), ("null", None, None), ("empty", "", "x"), ("utf8", hurt["utf8"][1], "https://utf8.example/x")]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string").selectExpr("*", "1 AS id", "2 AS swap")
    model = encodings.fit_letter_pairs(df, "content", samples)
    wrong, tables = encodings.wrong_readings(df, "doc_id", "content", "source", model)
    found = {r.id: r for r in wrong.collect()}
    assert {"lost", "utf8", "koi", "polish"} <= set(found) and len([i for i in found if i.startswith("ok")]) <= 3
    whole = {r.id: r for r in encodings.restored(df, "doc_id", "content", wrong, tables, model).collect()}
    assert whole["utf8"].content == hurt["utf8"][0] and whole["koi"].content == hurt["koi"][0] and not whole["lost"].restorable
    assert encodings.wrong_readings(df.limit(0), "doc_id", "content", "source", model)[0].count() == 0


def test_a_hot_source_of_one_swap_does_not_pass_for_language(spark, data):
    samples = spark.read.parquet(f"{data}/lang_samples.parquet")
    texts = [(r.lang, r.text) for r in samples.orderBy("sample_id").collect()]
    rng = random.Random(4)
    for lang, meant, read in (("ru", "cp1251", "koi8-r"), ("fr", "cp1252", "mac-roman")):
        own = ["".join(c for c in x if c.encode(meant, "ignore")) for k, x in texts if k == lang]
        rows = [(f"ok{i}", x, f"https://s{i % 9}.example/{i}") for i, (_, x) in enumerate(texts)]
        for k in range(len(texts) // 2):
            body = "\n".join(rng.sample(own, 3))
            rows.append((f"hot{k}", body.encode(meant).decode(read), f"https://hot.example/{k}"))
        df = spark.createDataFrame(rows, "doc_id string, content string, source string")
        model = encodings.fit_letter_pairs(df, "content", samples)
        found = {r.id for r in encodings.wrong_readings(df, "doc_id", "content", "source", model)[0].collect()}
        hot = {i for i, x, _ in rows if i.startswith("hot") and not x.isascii()}
        assert len(hot & found) >= 0.95 * len(hot) and len([i for i in found if i.startswith("ok")]) <= 5, (lang, len(hot & found), len(hot))


def test_mac_roman_among_clean_documents(spark, data):
    samples = spark.read.parquet(f"{data}/lang_samples.parquet")
    clean = samples.collect()
    fr = [r.text for r in clean if r.lang == "fr"]
    text = "\n".join((fr[0], fr[2], fr[3]))
    keep = "".join(c for c in text if c.encode("cp1252", "ignore"))
    rows = [(f"ok{i}", r.text, "file:///a") for i, r in enumerate(clean)] + [("mac", keep.encode("cp1252").decode("mac-roman"), "https://mac.example/x")]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string")
    wrong, _ = encodings.wrong_readings(df, "doc_id", "content", "source", encodings.fit_letter_pairs(df, "content", samples))
    assert "mac" in {r.id for r in wrong.collect()}


def test_readings_and_marks():
    assert ciphers.readings("Ã¼")["cp1252>utf-8"] == "ü"
    assert ciphers.translation("koi8-r>cp1251", ["н"], {}) is not None and ciphers.translation("cp1252>utf-8", ["Ã¼"], {}) is None
    assert ciphers.damaged("a �") and ciphers.damaged("the ?word?") and ciphers.damaged("x \x93y")
    assert not ciphers.damaged("really? yes") and not ciphers.damaged("see https://a.example/?q=x")


# ---- p3


def test_boilerplate(spark):
    rng = random.Random(0)
    nouns = "harbour clerk reader tutor valve badge parcel ledger meadow lantern".split()
    sentence = lambda: f"The {rng.choice(nouns)} stores the {rng.choice(nouns)} of a {rng.choice(nouns)} near the {rng.choice(nouns)}."
    rows = [(f"f{k}", "# Title here\n" + "\n".join(sentence() for _ in range(6)), "file:///x", "Title here") for k in range(60)]
    for k in range(60):
        body = [sentence() for _ in range(5)]
        rows.append((f"w{k}", "\n".join(["[Home](/a)", "[Contact](/b)", "# Title here", *body, "Share this page: mail – print", "© 2020 Brand. All rights reserved."]), "https://www.brand.example/x", "Title here"))
    rows += [("n", None, "https://x.example", None), ("e", "", "https://x.example", None), ("t", sentence(), "https://x.example", None), rows[-1]]
    df = spark.createDataFrame(rows, "doc_id string, content string, source string, title string").selectExpr("*", "0 AS line_no")
    cols = ("doc_id", "content", "source", "title")
    model = boilerplate.fit_line_model(df, *cols)
    got: dict = {}
    for r in boilerplate.boilerplate_lines(df, *cols, model).collect():
        got.setdefault(r.doc_id, set()).add(r.line_no)
    right = sum(got.get(f"w{k}") == {0, 1, 8, 9} for k in range(60))
    assert right >= 55 and "t" not in got and not any(i.startswith("f") for i in got)
    main = {r.doc_id: r.content for r in boilerplate.main_content(df, *cols, model).collect()}
    assert main["w0"].startswith("# Title here") and "Share" not in main["w0"] and main["e"] == ""
    empty = df.limit(0)
    assert boilerplate.boilerplate_lines(empty, *cols, boilerplate.fit_line_model(empty, *cols)).count() == 0


def test_text_to_tag_and_smoothing():
    ratio = pagelines.text_to_tag("[Home](/a) [Blog](/b)\nplain text of a line\n<p>x</p>")
    assert ratio[1] > ratio[0] and ratio[1] > ratio[2]
    flat = boilerplate.smooth(np.full(9, 2.0))
    assert np.allclose(flat, 2.0) and math.isclose(boilerplate.two_means(np.array([0.0, 0, 8, 8])), 4.0)


# ---- all queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() >= 0
    want = {"p1_found": ["doc_id"], "p2_found": ["id_a", "id_b"], "p3_found": ["doc_id", "line_no"], "p4_found": ["item_kind", "item_id"], "p5_found": ["id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "line_no", "lang"]}
    if name in want:
        assert df.columns == want[name]


def test_vocabulary_is_not_in_the_repository():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for _, _, files in os.walk(root) for f in files if f.endswith((".tiktoken", ".model", ".parquet"))]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_the_rows_of_their_sql(same_as_sql, name):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def test_recall_of_the_neighbours_against_brute_force(spark):
    """Both queries over the chunks of sf0.01, against all cosines."""
    folder = "/root/testdata/sf0.01"
    rows = {r.id: r.embedding for r in spark.read.parquet(f"{folder}/chunks.parquet").select("id", "embedding").collect()}
    ids = sorted(i for i, v in rows.items() if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v))
    x = np.array([rows[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 10)
    np.fill_diagonal(s, -2)
    best = [np.lexsort((np.arange(len(ids)), -row))[:5] for row in s]
    want = {(ids[i], ids[j]) for i, js in enumerate(best) for j in js}
    got = {(r.id, r.neighbour) for r in queries.p5_neighbours(spark, folder).collect()}
    assert len(got) == 5 * len(ids) and len(got & want) >= 0.9 * len(want)
    cases = {tuple(sorted((ids[i], ids[j]))) for i, js in enumerate(best) for j in js if s[i, j] >= 0.85}
    found = {(r.id_a, r.id_b) for r in queries.p5_found(spark, folder).collect()}
    assert len(found & cases) >= 0.98 * max(len(cases), len(found))
