"""The prefix trie against nested dictionaries and its SQL."""

import random

import brute
import duckdb
import pytest
from conftest import FOLDER
from marketloom.llm import prefix_trie as trie, queries

TURN = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Many short jobs over small tables: two partitions a shuffle."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def plain(rows):
    return sorted(tuple(r) for r in rows)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def run(spark, rows, rebuild=False, extra=()):
    df = spark.createDataFrame(rows, TURN).selectExpr("*", *extra)
    tokens = trie.turn_tokens(df)
    return [tuple(r) for r in trie.prefix_trie(*(trie.contract_rebuild(tokens) if rebuild else (tokens, tokens.where("d = 1").select("conv")))).collect()]


def test_two_fattest(spark):
    got = spark.range(0, 40).crossJoin(spark.range(1, 41).withColumnRenamed("id", "hi")).where("id < hi").withColumn("f", trie.two_fattest(*map(__import__("pyspark").sql.functions.col, ("id", "hi")))).collect()
    assert all(r["f"] == max(range(r["id"] + 1, r["hi"] + 1), key=lambda x: x & -x) for r in got)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(9)
    say = lambda n: [(rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randrange(3)) for _ in range(n)]
    convs = {c: say(rng.randrange(1, 7)) for c in range(160)}
    long = say(90)
    convs |= {200 + i: long[:rng.randrange(1, 91)] + say(rng.randrange(3)) for i in range(40)}
    convs |= {300 + i: [("system", "same"), ("user", "é🤖")] for i in range(60)} | {-5: say(3), -100: say(4), 1_000_000_007: long}
    rows = [(c, i, r or None, t or None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 1, "user", "lost"), (400, None, "user", "first"), (400, 5, "user", "x"), (400, 5, "user", "x"), (401, 1, None, None)] + [(510 + i, 1, "user", "hello") for i in range(12)]
    return rows


def test_odd_conversations(spark, odd):
    own = {}
    for c, _, r, x in sorted((r for r in odd if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((r or "", x or ""))
    assert sorted(run(spark, odd, extra=("1 conv", "2 d", "3 h0", "4 depth")), key=key) == sorted(brute.prefix_trie(own), key=key)


def test_rebuilt_conversations(spark, odd):
    want = brute.rebuilt_conversations(odd)
    assert any(not t for t in want.values())
    assert sorted(run(spark, odd, True), key=key) == sorted(brute.prefix_trie(want), key=key)


def test_small_blocks_and_chunks(spark, odd, monkeypatch):
    """Conversations longer than the block a search carries and the stretch that is scanned in one go."""
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "CHUNK", 16)
    assert sorted(run(spark, odd, True), key=key) == sorted(brute.prefix_trie(brute.rebuilt_conversations(odd)), key=key)


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    convs = spark.createDataFrame([(7,), (3,)], "conv long")
    none = trie.turn_tokens(spark.createDataFrame([], TURN))
    assert [tuple(r) for r in trie.prefix_trie(none, convs).collect()] == brute.prefix_trie({3: [], 7: []})


def test_locate_finds_the_deepest_handle(spark):
    rows = [(c, i, "user", t) for c, s in enumerate(["abcdefgh", "abcdxyz", "abq", "abcdefghij", "zzz"]) for i, t in enumerate(s)]
    paths = trie.prefix_table(trie.turn_tokens(spark.createDataFrame(rows, TURN)))
    ends = paths.groupBy("conv").agg(__import__("pyspark").sql.functions.max_by(__import__("pyspark").sql.functions.struct("h0", "h1"), "d").alias("x")).select("conv", "x.*")
    places = trie._places(paths.where("conv < 3"))
    nodes = trie.compacted(places, ends.where("conv < 3"), paths.where("conv < 3")).cache()
    assert sorted(r["depth"] for r in nodes.collect()) == [2, 3, 4, 7, 8]
    assert {r["conv"]: r["seen"] for r in trie.locate(paths, nodes).collect()} == {0: 8, 1: 6, 2: 3, 3: 8, 4: 0}


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{FOLDER}/conversations.parquet'")
    df = trie.op13_prefix_trie(spark, FOLDER)
    want = con.execute(queries.SQL["op13_prefix_trie"])
    assert sorted(df.columns) == sorted(d[0] for d in want.description)
    got = [tuple(r[d[0]] for d in want.description) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want.fetchall(), key=key)
