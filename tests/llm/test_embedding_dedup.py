"""Near duplicates among embeddings against all pairs."""

import brute
import numpy as np
import pytest
from marketloom.llm import embedding_dedup as dedup
from pyspark.sql import functions as F

VECTOR = "vec_id long, embedding array<double>, label int, dist int, x double"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """Many short jobs over small tables: two partitions a shuffle."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2.0) for i, v in rows], VECTOR)


@pytest.fixture(scope="module")
def rows():
    """Noise, a tight group far larger than a list, a loose group, exact and scaled copies, a chain, and rows that cannot link."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x)
    tight, loose, a, b = (unit(rng.normal(size=24)) for _ in range(4))
    out = [(i, unit(rng.normal(size=24))) for i in range(300)]
    out += [(1_000 + i, unit(tight + rng.normal(size=24) * 0.02)) for i in range(150)]
    out += [(2_000 + i, unit(loose + rng.normal(size=24) * 0.045)) for i in range(20)]
    out += [(3_000 + i, out[0][1] * (1 + i % 2 * 3)) for i in range(60)] + [(3_100, -out[0][1])]
    b = unit(b - a * (a @ b))
    out += [(4_000 + i, np.cos(i * 0.3) * a + np.sin(i * 0.3) * b) for i in range(9)]
    out = [(i, [float(c) for c in v]) for i, v in out]
    out += [(5_000, None), (5_001, []), (5_002, [0.0] * 24), (5_003, [1.0, None]), (5_004, [float("nan")] * 24), (5_005, [float("inf")] + [0.0] * 23), (5_006, out[0][1][:23]), (5_007, out[0][1][:23]), (5_008, [1e300] * 24), (5_009, [1e-300] * 24)]
    return out + [(None, out[5][1]), out[7], out[7], (4_000, out[9][1])]


def test_rows_against_all_pairs(spark, rows):
    got = {r["vec_id"]: tuple(r)[1:] for r in dedup.near_duplicate_vectors(table(spark, rows)).collect()}
    want = brute.vector_groups(rows)
    assert got.pop(None) == (0, None, False)
    assert set(got) == set(want) and {k: v for k, v in got.items() if v != want[k]} == {}
    assert got[1_000][0] >= 100 and got[3_005] == (60, 0, False) and got[0] == (60, 0, True)


def test_small_and_empty_tables(spark, rows):
    assert dedup.near_duplicate_vectors(table(spark, [])).collect() == []
    one = dedup.near_duplicate_vectors(table(spark, rows[:1])).collect()
    assert [tuple(r) for r in one] == [(0, 0, 0, True)]


def test_audit_sees_lost_links(spark, rows):
    some = [(i, v) for i, v in rows if i is not None and i < 2_000]
    heads = dedup.unit_vectors(table(spark, some)).withColumn("w", F.lit(1).cast("long")).dropDuplicates(["id"])
    lost = heads.select("id", F.lit(0).cast("long").alias("n"))
    assert dedup.audit(heads, lost, 0.95) == 0
    right = brute.vector_groups(some)
    right = spark.createDataFrame([(i, n) for i, (n, _, _) in right.items()], "id long, n long")
    assert dedup.audit(heads, right, 0.95) == 1


def test_search_that_finds_too_little_is_an_error(spark, rows, monkeypatch):
    monkeypatch.setattr(dedup, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError):
        dedup.near_duplicate_vectors(table(spark, rows[:30]))
