"""Dealt operators against plain forms, a public library or held-out labels, with the awkward cases each docstring defines."""

import hashlib
import math
import random
import re
import struct

import brute
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import FOLDER
from marketloom.llm import automaton, decontamination, html_extraction, jaccard_join, language_id, licenses, secrets, sentencepiece as pieces, token_counts, toxicity, vector_search

MODEL = pieces.public_model()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    """rows: (doc_id, text); columns with names that operators use themselves can be added."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in rows], DOC)
    return df.selectExpr("*", *extra.split(";")) if extra else df


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(4)
    base = [prose(rng, 60, 100_000) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, None), (11, ""), (12, "   \n\t"), (13, "one two"), (14, "One TWO"), (15, "x" * 50_000), (16, "é漢字 🤖 ß " * 40), (17, base[0]), (18, base[0].upper())]
    rows += [(20 + k, " ".join(w if rng.random() > 0.02 else f"e{rng.randrange(9)}" for w in base[1].split())) for k in range(30)]
    rows += [(60 + k, base[2] + " " + prose(rng, 70, 100_000)) for k in range(20)]  # a shared passage, no near copies
    rows += [(90, prose(rng, 30_000)), (91, "AKIA" + "A" * 20 + " token=abcdefgh " + "0123456789abcdef" * 3)]
    return rows


def test_near_duplicates(spark, odd_rows):
    got = jaccard_join.near_duplicates(docs(spark, odd_rows, "1 as n;2 as sid;3 as hub;'x' as root")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute.near_duplicates(odd_rows) and len(got) == len(odd_rows)


def test_near_duplicates_hot_group_of_near_copies(spark):
    rng = random.Random(8)
    base = prose(rng, 150, 10**6).split()
    rows = [(k, " ".join(w if rng.random() > rng.choice((0.005, 0.02, 0.03)) else f"n{rng.randrange(10**6)}" for w in base)) for k in range(250)]
    rows += [(1000 + k, " ".join(base[:70]) + " " + prose(rng, 25, 10**6)) for k in range(60)] + [(2000 + k, rows[3][1]) for k in range(300)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(docs(spark, rows).repartition(16)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_too_many_edits_do_not_meet_in_the_remainder(spark, monkeypatch):
    """Half the group links with its leader, the other half shares prefix tokens with all of it and links with nothing: those pairs are no rows."""
    rng = random.Random(12)
    base = prose(rng, 150, 10**6).split()
    rows = []
    for k in range(240):
        at = set(rng.sample(range(10, 140), 1 if k % 2 else 4))
        rows.append((k, " ".join(f"n{k}x{i}" if i in at else w for i, w in enumerate(base))))
    real, pairs = jaccard_join.stored, []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, name: pairs.append(df.count()) or real(df, name) if name == "rest" else real(df, name))
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows) and len(pairs) == 1 and pairs[0] < 5_000


def test_sketches_never_deny_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 127, 129, 255, 257, 400, 511, 513, 900, 3000):
        for share in (0.75, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[:int(len(a) * share)], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
            x, y = sorted((jaccard_join.sketch(a), jaccard_join.sketch(b)), key=len)
            if not len(x) or len(y) > 2 * len(x):
                continue
            y = y[:len(x)] ^ y[len(x):] if len(y) > len(x) else y
            ones = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert ones <= len(np.setxor1d(a, b)) and 4 <= len(x) <= jaccard_join.SKETCH // 64


def test_postings_of_copies_are_few_and_dealt():
    """Copies of one text, all tokens heavy: one posting a token from each task, over many buckets."""
    text, buckets = prose(random.Random(5), 600, 10**6), 16
    tokens = jaccard_join.shingle_sets(pa.array([text]))[0]
    keys = jaccard_join._key(jaccard_join._bucket(tokens, buckets), tokens & jaccard_join.LOW32)
    heavy = (np.sort(keys), np.full(len(keys), 400), jaccard_join.bitmap(keys))
    batches = [pa.RecordBatch.from_arrays([pa.array([text] * 40)], names=["text"]) for _ in range(10)]
    size = {}
    for b in jaccard_join._postings(iter(batches), 5, 75, buckets, heavy):
        for k, t in zip(b.column("bucket").to_pylist(), b.column("token").to_pylist(), strict=True):
            size[k] = size.get(k, 0) + len(t)
    posted = len(jaccard_join.prefix(tokens, np.full(len(tokens), 400))[0])
    assert sum(size.values()) == posted and len(size) == buckets and max(size.values()) < posted / 4


def test_near_duplicates_nulls_repeats_empty(spark):
    got = jaccard_join.near_duplicates(docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (4, 0, 4)], key=str)
    assert jaccard_join.near_duplicates(docs(spark, [])).collect() == []


def test_prefix_of_linked_sets_shares_enough():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 80))
        a = np.unique(rng.integers(1, 1 << 40, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.12], rng.integers(1, 1 << 40, int(rng.integers(0, 8))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        weight = {int(t): int(c) for t, c in zip(np.union1d(a, b), rng.choice([0, 0, 20, 500], len(np.union1d(a, b))))}
        (oa, la), (ob, lb) = (jaccard_join.prefix(s, np.array([weight[int(t)] for t in s])) for s in (a, b))
        assert len(np.intersect1d(a[oa], b[ob])) >= min(la, lb)


def test_contamination(spark, odd_rows):
    items = [(1, " ".join(odd_rows[1][1].split()[5:40])), (2, "one two"), (3, ""), (4, None), (None, "w1 w2"), (2, "ONE  two"), (10, odd_rows[0][1]), (5, "é漢字 🤖")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(odd_rows, items)
    for block in (1 << 20, 30):  # one block, many blocks
        got = decontamination.matches(docs(spark, odd_rows, "1 as n_words;'x' as items"), bench, block_bytes=block).selectExpr("*", "n_hit > 0 and 20 * n_hit >= n_words as contaminated").collect()
        assert len(got) == len(odd_rows)
        assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got} == want
    longest = {r.doc_id: r.longest_match for r in got}
    assert longest[1] >= 35 and longest[0] == 60
    kept = decontamination.decontaminate(docs(spark, odd_rows, "1 as n_words;'x' as items"), bench)
    assert kept.columns[-2:] == ["n_words", "items"] and {r[0] for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    assert decontamination.contamination(docs(spark, odd_rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(docs(spark, []), bench).collect() == []


def test_sentencepiece_equals_the_library():
    m, lib, rng = pieces.model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "▁", "ß", "漢", "梦", "🤖", "'s", ".", "...", "***", "//", "http", "<s>", "0", "\t", "_", "==", "    ", "\x00", " "]
    texts = ["", " ", "x" * 3000, "\n" * 50] + [" " * n for n in (1, 7, 17, 33, 300, 700, 1030)] + ["a" + " " * n + "梦\n" for n in range(30)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    ids, at = m.encode_batch(texts)
    for i, (t, want) in enumerate(zip(texts, lib.encode(texts, add_bos=True, add_eos=True))):
        got = ids[at[i]:at[i + 1]].tolist()
        assert got == want and m.decode(got) == lib.decode(got), t[:40]
    assert m.decode([m.byte_ids[0xE6], 13, m.byte_ids[0xFF]]) == lib.decode([m.byte_ids[0xE6], 13, m.byte_ids[0xFF]])


def test_sentencepiece_frames(spark, odd_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in pieces.digests(docs(spark, odd_rows), MODEL).collect()}
    for d, t in odd_rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
    full = pieces.encode(docs(spark, odd_rows[:3], "'x' as ids"), MODEL).collect()
    assert [r["ids"] for r in full] == [lib.encode(t, add_bos=True, add_eos=True) for _, t in odd_rows[:3]]
    assert pieces.encode(docs(spark, []), MODEL).collect() == []


def test_secrets(spark, odd_rows):
    rng = random.Random(3)
    parts = ["token", "=", ":", " ", '"', "'", "PassWord", "api_key", "apikey", "AKIA", "ABCDEFGH12", "0123456789abcdef", "deadbeef", "é", "xoxb-", "ghp_", "eyJab", ".", "\n", "secret", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "漢"]
    rows = odd_rows + [(1000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for k in range(400)] + [(2000, "a" * 9000 + "f" * 5000 + "token=abcdefgh")]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans] for r in secrets.scan(docs(spark, rows, "1 as secret_spans")).collect()}
    assert got == {d: brute.secrets(t, secrets.RULES) for d, t in rows}
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows)).collect()}
    for d, t in rows:
        if not got[d]:
            assert clean[d] == t
        else:
            assert len(re.findall(re.escape("[secret]"), clean[d])) >= 1
    assert clean[91] == "[secret] [secret] [secret]" and secrets.scan(docs(spark, [])).collect() == []


def test_automaton_is_minimal_and_matches_regex():
    one = automaton.compile_rules(["(ab|ac)*d", "a+b"], search=False)
    for text in ("abacd", "d", "aab", "ab", "abab", "x", ""):
        want = max((m.end() for p in ("(ab|ac)*d", "a+b") if (m := re.match(p, text))), default=-1)
        assert one.longest(text.encode(), 0) == want
    assert len(automaton.compile_rules(["aa|ab|ba|bb"], search=False).accepts) == 4  # start, one letter, two letters, dead


def test_token_counts(spark, odd_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = {lib.id_to_piece(i) for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs(spark, odd_rows, "9 as n_tokens"), MODEL).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert got == {d: (len(split(t)), sum(brute.greedy_pieces(w, vocabulary) for w in split(t))) for d, t in odd_rows if d != 15} | {15: got[15]}
    rng = random.Random(2)
    for _ in range(200):
        v = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(6)} | {"▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(3)}
        m = token_counts.LongestMatch(sorted(v))
        for _ in range(40):
            w = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
            assert m.count(w) == brute.greedy_pieces(w, v)


PARA = "This is a long paragraph, with some words; it goes on and on. It has several sentences, too!"


@pytest.mark.parametrize("body, want", [
    (f"<header><h1>Site</h1></header><div class='menu'><a href=/>Home</a></div><div id=content><h1>Title here</h1><p>{PARA}</p><p>Short.</p><ul><li>One</li></ul><div class=share>Share</div><p>{PARA} &eacute;&nbsp;x &lt;b&gt;</p></div>"
     f"<div class=sidebar><p>{PARA}</p></div><div class=comments><p>{PARA}</p><p>{PARA}</p></div><form><p>{PARA}</p></form><footer>(c)</footer>", f"Title here\n{PARA}\nShort.\nOne\n{PARA} é x <b>"),
    (f"<nav><a>x</a></nav><article><header><h1>Head</h1></header><p>{PARA}<br>two<aside>{PARA}</aside><p><b>open<p>end<script>var x='<p>no</p>'</script></article><p>{PARA}</p>", f"Head\n{PARA} two\nopen\nend"),
    ("<article></article><p>other text, here.</p>", ""), ("", ""),
])
def test_html(body, want):
    assert html_extraction.extract(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>") == want


def test_html_frames(spark):
    rows = [(1, "u", f"<p>{PARA}</p>"), (2, None, None), (3, "u", ""), (4, "u", "plain &amp"), (5, "u", f"<p>{PARA}" + " word" * 40_000), (1, "u", f"<p>{PARA}</p>"), (None, "v", "<p>cut <b cla")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "5 as text", "'z' as more")
    got = html_extraction.main_text(df).collect()
    assert [(r.page_id, r.text[:12], r.more) for r in got] == [(1, PARA[:12], "z"), (2, "", "z"), (3, "", "z"), (4, "plain &", "z"), (5, PARA[:12], "z"), (1, PARA[:12], "z"), (None, "cut", "z")]
    assert all(r.n_chars == len(r.text) for r in got) and html_extraction.main_text(df.limit(0)).collect() == []


def test_repeated_words_are_one_window():
    """An item and a shard of one word over and over: each place counts once, and items that share a window share its places."""
    tests = decontamination.suffixes_of(["x", "y", "z"], ["the " * 60, "the " * 20, "the the"], 13)
    assert len(tests.window) == 2
    words, first = decontamination._words(pa.array(["the " * 8_000, "no the the the"]))
    (at, length, group), longest, _ = decontamination.shard_matches(words, first, tests, 13)
    assert len(at) < 20_000 and longest.max() == 60
    items = {tests.names[i] for g in np.unique(group) for i in tests.members[tests.bounds[g]:tests.bounds[g + 1]]}
    assert items == {"x", "y", "z"} and decontamination._marks(len(words), at, length).sum() == 8_003


def test_decontaminate_by_one_block_or_several(spark, monkeypatch):
    rng = random.Random(12)
    bench = [(f"i{k}", prose(rng, 40, 10_000)) for k in range(6)]
    rows = [(k, (bench[k % 6][1] if k % 3 == 0 else "") + " " + prose(rng, 80, 10_000)) for k in range(40)] + [(90, None), (91, "")]
    b = spark.createDataFrame(bench, "item_id string, text string")
    one = sorted(r.doc_id for r in decontamination.decontaminate(docs(spark, rows), b).collect())
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert one == sorted(r.doc_id for r in decontamination.decontaminate(docs(spark, rows), b).collect()) == [k for k, _ in rows if k % 3 or k >= 90]


def test_language_forward_is_the_sum_over_segmentations():
    m = language_id.train([("a", "the thing then"), ("b", "der die das größe")], MODEL)
    for w in ("the", "größen", "x", "漢字", "thingthe"):
        x, vocab = "▁" + w, m.vocab
        for k in range(2):
            a = [1.0] + [0.0] * len(x)
            for j in range(1, len(x) + 1):
                for n in [n for n in vocab.lengths if n <= j]:
                    h = language_id._gram_hash(np.array([ord(c) for c in x[j - n:j]], np.uint32), n)[0]
                    i = int(np.searchsorted(vocab.hashes, h))
                    a[j] += a[j - n] * (m.p[k, i] if i < len(vocab) and vocab.hashes[i] == h else m.p[k, -1] if n == 1 else 0)
            assert math.isclose(language_id.word_scores(language_id.lattice([w], vocab), m.p)[0, k], math.log(a[-1]), rel_tol=1e-9)


def test_language_held_out(spark):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language_id.identify(d.select("doc_id", "text", "lang"), language_id.fit(d, MODEL)).where(toxicity.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 10
    odd = language_id.identify(docs(spark, [(1, None), (2, ""), (3, "12 !! — …"), (4, "the and of it")], "1 as score"), language_id.fit(d, MODEL)).collect()
    assert [(r.lang_pred, r.score) for r in odd[:3]] == [("und", 0.0)] * 3 and odd[3].lang_pred == "en" and 0 < odd[3].score <= 1
    assert language_id.identify(docs(spark, [(1, "x")]), language_id.fit(docs(spark, []), MODEL)).first().lang_pred == "und"


def test_language_scores_of_words_live_on(monkeypatch):
    """Slices give one answer whether scores of words are kept, dropped in between or made anew; very long and repeated texts too."""
    m = language_id.train([("a", "the thing then other"), ("b", "der die das größe andere")], MODEL)
    texts = ["the thing 漢字", "größe der x", "the " * 60_000, "the thing 漢字", None, "--", "ab" * 30_000]
    whole = m.predict(pa.array(texts, pa.string()))
    fresh = language_id.Model(m.langs, m.p, m.prior, m.vocab)
    monkeypatch.setattr(language_id, "KEPT_BYTES", 0)
    single = [fresh.predict(pa.array([t], pa.string())) for t in texts]
    assert whole[0] == [s[0][0] for s in single] == ["a", "b", "a", "a", "und", "und", whole[0][-1]]
    np.testing.assert_allclose(whole[1], [s[1][0] for s in single], rtol=1e-9)
    assert max(m.vocab.lengths) > 8


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 16)], 0) for i in range(700)] + [(700 + i, [0.5] * 16, 0) for i in range(400)]  # a third equal
    rows += [(2000, None, 0), (2100, [1.0, None] + [0.0] * 14, 0), (2200, [float("nan")] * 16, 0), (2300, [float("inf")] * 16, 0), (2400, [], 0), (None, [0.1] * 16, 0), (2500, [0.1, 0.2], 0), (0, rows[0][1], 0)]
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = vector_search.top_k(v, v.where("vec_id % 100 = 0"), 10).collect()
    vecs = {i: np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int) for i, x, _ in rows if i is not None and i < 1200}
    want = set()
    for q in (i for i in vecs if i % 100 == 0):
        best = sorted((-int(vecs[q] @ x), i) for i, x in vecs.items() if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vector_search.top_k(v.limit(0), v.limit(0)).collect() == []


def test_top_k_counts_repeated_ids_once(spark):
    """Every row twice, and one id with the best vectors of all many times over."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 8)]) for i in range(300)] * 2 + [(301, [0.9 + 0.001 * j] * 8) for j in range(30)]
    v = vector_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).coalesce(1)
    got = vector_search.top_k(v, v.where("vec_id % 100 = 0"), 10).collect()
    vecs = [(i, np.floor(1024 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows]
    want = set()
    for q in (0, 100, 200):
        top, x = {}, dict(vecs)[q]
        for i, y in vecs:
            if i != q:
                top[i] = max(top.get(i, -10**18), int(x @ y))
        want |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(top.items(), key=lambda t: (-t[1], t[0]))[:10])}
    assert {tuple(r) for r in got} == want and len(got) == 30
    s, i = vector_search._top(np.array([[9, 9, 8, 7, 5], [1, 2, 3, 4, 5]]), np.array([[4, 4, 4, 2, 1], [1, 2, 3, 4, 5]]), 3)
    assert s.tolist() == [[9, 7, 5], [5, 4, 3]] and i.tolist() == [[4, 2, 1], [5, 4, 3]]


def test_products_are_exact_beyond_doubles():
    a = np.array([[3_037_000_499, 1]], np.int64)
    assert vector_search.products(a, np.array([[3_037_000_498, 1]], np.int64))[0, 0] == 3_037_000_499 * 3_037_000_498 + 1


def test_licenses(spark):
    rng = random.Random(1)
    mit = licenses.TEMPLATES["mit-permission"]
    rows = [(1, prose(rng, 50) + " Released under the MIT license. " + prose(rng, 30)), (2, "all RIGHTS reserved"), (3, None), (4, ""), (5, "two words"), (6, prose(rng, 3000) + mit + prose(rng, 3000)),
            (7, mit.replace("charge", "fee")), (8, "permission is hereby granted"), (9, "All rights reserved. " * 50)]
    got = {(r.doc_id, r.license): (round(r.containment, 6), r.first_word) for r in licenses.scan(docs(spark, rows, "1 as h;2 as c")).collect()}
    assert set(got) == {(1, "mit"), (2, "all-rights-reserved"), (6, "mit-permission"), (7, "mit-permission"), (9, "all-rights-reserved")}
    assert got[2, "all-rights-reserved"] == (1.0, 0) and got[1, "mit"] == (1.0, 50) and got[6, "mit-permission"][0] >= 0.9
    assert licenses.scan(docs(spark, [])).collect() == [] and "Python" not in licenses.scan(docs(spark, rows))._jdf.queryExecution().toString()


def test_toxicity_learns_words_and_shares_subwords(spark):
    rng = random.Random(9)
    bad = ["blorgle", "snarfing", "quibbert"]
    texts, marks = [], []
    for k in range(400):
        w = prose(rng, rng.randint(5, 120), 3000).split()
        if k % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        marks.append(int(k % 4 == 0))
    m = toxicity.train(texts[:300], np.array(marks[:300]))
    s, y = m.scores(pa.array(texts[300:], pa.large_string())), np.array(marks[300:])
    assert ((s >= toxicity.THRESHOLD) == (y == 1)).mean() >= 0.95
    miss, plain = m.scores(pa.array(["w1 w2 blorgel w3", "w1 w2 drapel w3"], pa.large_string()))
    assert miss > 2 * plain  # an unseen misspelling
    odd = toxicity.score(docs(spark, [(1, None), (2, ""), (3, "word " * 30_000), (4, "...")], "1 as toxicity"), m).collect()
    assert [0 <= r.toxicity <= 1 for r in odd] == [True] * 4 and odd[0].toxicity == odd[1].toxicity == odd[3].toxicity
    none = toxicity.fit(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.scores(pa.array(["a"], pa.large_string()))[0] <= 0.5


def test_toxicity_passes_over_texts_that_do_not_fit(spark):
    """One labelled text longer than the whole bound, wherever its hash puts it, leaves the others to be learned."""
    rng = random.Random(10)
    rows = [(k, "blorgle " * (k % 2) + prose(rng, 20, 300)) for k in range(120)]
    marks = spark.createDataFrame([(k, 1, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    first = [r.doc_id for r in toxicity.labelled_sample(docs(spark, rows), marks, 3000).orderBy(toxicity.F.xxhash64("doc_id", toxicity.F.lit(1))).collect()]
    rows[first[0]] = (first[0], rows[first[0]][1] * 1000)
    m = toxicity.fit(docs(spark, rows), marks, most_bytes=40_000)
    assert (lambda bad, good: bad >= toxicity.THRESHOLD > good)(*m.scores(pa.array(["w1 blorgle w2", "w1 w3 w2"], pa.large_string())))
    assert toxicity.choose([("a", 0, 90), ("b", 0, 30), ("c", 1, 60), ("d", 1, 20), ("e", 0, 30)], 100) == ["b", "d", "e"]
    assert toxicity.choose([("a", 0, 40), ("b", 0, 40), ("c", 1, 20)], 100) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="class 1"):
        toxicity.choose([("a", 0, 10), ("b", 1, 101)], 100)
