"""Periodic runs against a period-by-period search."""

import random

import brute
import numpy as np
import pytest
from conftest import FOLDER
from hypothesis import given, settings, strategies as st
from marketloom.llm import periodic_runs
from test_operators import docs

COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def flat(words):
    return np.array([w for r in words for w in r], np.uint64), np.cumsum([0, *[len(r) for r in words]])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(1, 9), st.integers(3, 9))
def test_runs_are_all_found(rows, period, times):
    rows.append((rows[0][:period] or [1]) * times + rows[0])
    got = [tuple(x) for x in zip(*(a.tolist() for a in periodic_runs.find_runs(*flat(rows))))]
    assert got == [(i, *r) for i, w in enumerate(rows) for r in brute.runs(w)]


def test_three_periods():
    rng = random.Random(3)
    w = [rng.randrange(2) for _ in range(400)] + [rng.randrange(9) for _ in range(37)] * 3
    got = [tuple(x) for x in zip(*(a.tolist() for a in periodic_runs.find_runs(*flat([w]), 3, 5)[1:]))]
    assert got == brute.runs(w, 3, 5)


def test_odd_texts(spark):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a " * 6), (6, "a " * 5), (7, "x y " * 4), (8, "x y " * 4 + "x"), (9, "é 漢 🤖 ß " * 9), (9, "é 漢 🤖 ß " * 9), (None, "b " * 20), (-7, word(900))]
    rows += [(100 + i, word(rng.randrange(200)) + " " + (word(rng.randrange(1, 30)) + "\x0b") * rng.randrange(9) + word(50)) for i in range(120)]
    rows += [(300, "one two three " * 20_000 + word(500) + " " + " ".join(f"w{i}" for i in range(3_000)) * 5)]
    got = periodic_runs.periodic_runs(docs(spark, rows, "1 _text;2 n_runs;3 _rebuild"), ["doc_id"], "text", periodic_runs.contract_rebuild).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    small = [r for r in rows if r[0] != 300]
    assert sorted((tuple(r) for r in got if r["doc_id"] != 300), key=key) == sorted(((d, *brute.run_row(d, t)) for d, t in small), key=key)
    big = next(r for r in got if r["doc_id"] == 300)
    assert (big["start"], big["length"], big["period"]) == (0, 60_000, 3) and big["n_runs"] >= 2
    assert not periodic_runs.periodic_runs(docs(spark, []), ["doc_id"]).collect()
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs(spark, []), ["doc_id"], power=2)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = periodic_runs.op12_periodic_runs(spark, FOLDER).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) > 5
    short = [r for r in got if len(texts[r["doc_id"]] or "") < 20_000]
    assert len(short) > 100 and all(tuple(r) == (r["doc_id"], *brute.run_row(r["doc_id"], texts[r["doc_id"]])) for r in short)
