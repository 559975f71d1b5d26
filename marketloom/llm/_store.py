"""Intermediate tables in the cluster's shared folder, and connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of few rows while jobs run inside: whole texts are wide, and both the executor and its Python worker hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: lineage ends at files that outlive executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of `stored` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver collect plans that nothing holds any more: Spark then deletes their shuffle files, which a loop of many short jobs piles up."""
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge table (a long, b long); root is the smallest node reachable.

    Alternating large-star and small-star steps: minima per node come from partial aggregates and meet the edges in a join,
    so a node with very many edges is never gathered in one task; the rounds grow with the logarithm of a component's size.
    """
    def digest(e):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = digest(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, name)
        now = digest(new)
        discard(cur)
        cur, done = new, now == seen
        seen = now
        if done:
            break
    roots = cur.select(F.col("v").alias("u")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
