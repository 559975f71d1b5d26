"""Prefix trie of conversations: a z-fast trie over tables, filled in batches through fat binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans import row_index
from ._store import discard, stored

FIRST = 8  # the first batch takes one conversation in so many, every later one as many times more
CHUNK = 4_096  # turns of one conversation that are scanned in one go
BLOCK = 1_024  # prefix hashes of a conversation that travel with its search
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["h0", "h1"]


def turn_tokens(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, d, t0, t1, chars): turns numbered from 1 in order of `turn` (null first; ties: role, length, hash), as 128-bit hashes with code points.

    Null roles and texts are empty. Rows with a null conversation belong to none and are left out; repeated rows are turns of their own.
    Positions come from counts per stretch of turns, so that one very long conversation is many tasks.
    """
    r, t = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    at = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63)))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), at.alias("_t"), r.alias("_r"), F.char_length(t).cast("long").alias("chars"),
                                                       F.xxhash64(r, F.lit(1), t).alias("t0"), F.xxhash64(F.lit(2), t, r).alias("t1"))
    rows = row_index(rows, ["conv"], ["_t", "_r", "chars", "t0", "t1"], F.floor(F.col("_t") / CHUNK).cast("long"))
    return rows.select("conv", (F.col("_i") + 1).cast("long").alias("d"), "t0", "t1", "chars")


def prefix_table(tokens: DataFrame) -> DataFrame:
    """tokens (conv, d from 1 without gaps, t0, t1, chars) -> (conv, d, h0, h1 hash of the first d turns, p0, p1 that of the first d - 1, sums code points so
    far). A prefix's hash is the exclusive or of its turns hashed with their depth, so stretches of a long conversation combine."""
    x = tokens.withColumns({"x0": F.xxhash64("d", "t0", "t1"), "x1": F.xxhash64("t1", "d", "t0"), "_k": F.floor((F.col("d") - 1) / CHUNK)})
    total = x.where(F.col("_k") >= 0).groupBy("conv", "_k").agg(F.bit_xor("x0").alias("c0"), F.bit_xor("x1").alias("c1"), F.sum("chars").alias("c"))
    before = Window.partitionBy("conv").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select("conv", "_k", F.bit_xor("c0").over(before).alias("c0"), F.bit_xor("c1").over(before).alias("c1"), F.sum("c").over(before).alias("c")).where("_k > 0")
    w = Window.partitionBy("conv", "_k").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = x.select("conv", "_k", "d", "x0", "x1", F.bit_xor("x0").over(w).alias("s0"), F.bit_xor("x1").over(w).alias("s1"), F.sum("chars").over(w).alias("s"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("long"))
    out = run.join(carry, ["conv", "_k"], "left").select("conv", "d", "x0", "x1", F.col("s0").bitwiseXOR(zero("c0")).alias("h0"), F.col("s1").bitwiseXOR(zero("c1")).alias("h1"), (F.col("s") + zero("c")).alias("sums"))
    return out.select("conv", "d", *KEY, F.col("h0").bitwiseXOR(F.col("x0")).alias("p0"), F.col("h1").bitwiseXOR(F.col("x1")).alias("p1"), "sums")


def two_fattest(lo, hi) -> Column:
    """The number in (lo, hi] that the highest power of two divides."""
    k = F.length(F.bin(lo.bitwiseXOR(hi))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", hi, k), k)


def compacted(places: DataFrame, ends: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of the compacted trie: places where a conversation ends or two or more children follow, with the hash of the place at the two-fattest depth
    of the edge above them as handle. (h0, h1, depth, kids, f0, f1)

    places: every distinct prefix (h0, h1, d, p0, p1, witness conversation); paths: the prefix table of the witnesses.
    """
    kids = places.groupBy(F.col("p0").alias("h0"), F.col("p1").alias("h1")).agg(F.count(F.lit(1)).alias("kids"))
    marked = places.join(kids, KEY, "left").join(ends.select(*KEY).distinct().withColumn("ends", F.lit(True)), KEY, "left")
    nodes = marked.where("ends or kids > 1").select(*KEY, F.col("d").alias("depth"), F.coalesce("kids", F.lit(0)).alias("kids"), "witness")
    on_path = paths.select("conv", "d", *KEY).join(nodes, KEY).select("conv", *KEY, "depth", "kids", "witness")
    above = F.coalesce(F.lag("depth").over(Window.partitionBy("conv").orderBy("depth")), F.lit(0).cast("long"))
    own = on_path.withColumn("above", above).where("conv = witness").withColumn("f", two_fattest(F.col("above"), F.col("depth")))
    handle = paths.select("conv", F.col("d").alias("f"), F.col("h0").alias("f0"), F.col("h1").alias("f1"))
    return own.join(handle, ["conv", "f"]).select(*KEY, "depth", "kids", "f0", "f1")


def _places(paths: DataFrame) -> DataFrame:
    """Distinct prefixes of a prefix table, each with one conversation that holds it."""
    return paths.groupBy(*KEY).agg(F.min("conv").alias("witness"), F.first("d").alias("d"), F.first("p0").alias("p0"), F.first("p1").alias("p1"))


def locate(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv, seen): for each conversation the depth of the deepest handle it matches, by fat binary search over the depths of its turns.

    A probe at the two-fattest depth of (lo, hi] looks its prefix up among the handles: a hit moves lo to the node's depth, a miss hi below the
    probe. Searches that have ended leave the rounds; there are as many rounds as the longest conversation's length has binary digits. A search
    carries the block of prefix hashes around its probe; those of longer conversations fetch another block when the probe leaves theirs.
    """
    blocks = paths.groupBy("conv", F.floor((F.col("d") - 1) / BLOCK).alias("blk")).agg(F.array_sort(F.collect_list(F.struct("d", *KEY))).alias("hs"))
    length = paths.groupBy("conv").agg(F.max("d").alias("hi"))
    longest = length.agg(F.max("hi")).first()[0] or 0
    zero = F.lit(0).cast("long")
    state = length.join(blocks.where("blk = 0"), "conv").select("conv", zero.alias("lo"), "hi", zero.alias("seen"), "blk", "hs")
    handles = nodes.select("depth", F.col("f0").alias("h0"), F.col("f1").alias("h1"))
    done, round_ = [], 0
    while round_ == 0 or active.limit(1).count():
        now = state if round_ == 0 else active
        now = now.withColumn("f", two_fattest(F.col("lo"), F.col("hi"))).withColumn("want", F.floor((F.col("f") - 1) / BLOCK))
        if longest > BLOCK:
            other = now.where("want <> blk").drop("blk", "hs").join(blocks.withColumnRenamed("blk", "want"), ["conv", "want"]).withColumn("blk", F.col("want"))
            now = now.where("want = blk").unionByName(other)
        probe = now.withColumn("_h", F.expr(f"hs[int((f - 1) % {BLOCK})]")).withColumns({"h0": F.col("_h.h0"), "h1": F.col("_h.h1")}).drop("_h", "want")
        met = probe.join(handles, KEY, "left")
        hit = F.col("depth").isNotNull()
        met = met.select("conv", F.when(hit, F.col("depth")).otherwise(F.col("lo")).alias("lo"), F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                         F.when(hit, F.col("f")).otherwise(F.col("seen")).alias("seen"), "blk", "hs")
        met = stored(met.withColumn("hs", F.when(F.col("lo") < F.col("hi"), F.col("hs"))), "fat-search")
        done.append(met)
        active = met.where("lo < hi")
        round_ += 1
    out = done[0].where("lo >= hi").select("conv", "seen")
    for t in done[1:]:
        out = out.union(t.where("lo >= hi").select("conv", "seen"))
    out = stored(out, "located")
    discard(*done)
    return out


def build(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct prefixes and the compacted nodes of the trie over a prefix table, inserted in batches that grow eightfold.

    The first batch is compacted from its own prefixes. Each conversation of a later batch is located in the trie as it stands; only its turns below the
    deepest matched handle are compared with the edges there, and only what lies beyond its exit enters the trie, compacted with the rest of the batch.
    """
    ends = stored(paths.groupBy("conv").agg(F.max(F.struct("d", *KEY)).alias("x")).select("conv", "x.*"), "ends")
    share = F.pmod(F.xxhash64(F.col("conv"), F.lit(7)), F.lit(FIRST * FIRST))
    batches = [share == 0, (share > 0) & (share < FIRST), share >= FIRST]
    seen, places, nodes = None, None, None
    for batch in batches:
        part = paths.where(batch)
        if places is None:
            new = _places(part)
        else:
            found = locate(part, nodes)
            below = part.join(found, "conv").where("d > seen")
            new = _places(below.join(places.select(*KEY), KEY, "left_anti")).select(places.columns)
            new = places.union(new)
        seen = batch if seen is None else seen | batch
        fresh = stored(new, "places")
        kept = stored(compacted(fresh, ends.where(seen), paths.where(seen)), "nodes")
        if places is not None:
            discard(places, nodes, found)
        places, nodes = fresh, kept
    return places, nodes, ends


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node of its conversations' ids, which arrive sorted; no list is held."""
    key, sha, out = None, None, []
    for b in batches:
        for h0, h1, conv in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (h0, h1) == key:
                sha.update(f",{conv}".encode())
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (h0, h1), hashlib.sha256(str(conv).encode())
        if len(out) > 10_000:
            yield _rows(out)
            out = []
    if key:
        out.append((*key, sha.hexdigest()))
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], names=["h0", "h1", "ends_sha256"])


def prefix_trie(tokens: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over conversations: conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless
    nodes of its subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) times the code points of the node's last turn), ends_sha256.

    tokens: (conv, d, t0, t1, chars) as `turn_tokens` gives them, d from 1 without gaps. convs: (conv) every conversation, turnless ones too, once each.
    Without conversations there are no rows; with turnless ones alone there is the root, its own leaf.

    The z-fast trie gives the compacted nodes. Expanding the edges: every turn of a path belongs to the first node at or below it, and the conversation
    with the smallest id of that node tells the edge's rows. Sums over a subtree need no walk up the tree: along each path, what that
    conversation contributes to a node is the sum of its own nodes from there on. 64-bit pairs of hashes stand for prefixes: two different ones
    collide with a probability of about 2**-128.
    """
    spark = tokens.sparkSession
    paths = stored(prefix_table(tokens), "prefixes")
    places, nodes, ends = build(paths)

    node = F.struct(*KEY, F.col("depth").alias("depth"), F.col("sums").alias("sums"), "kids")
    down = Window.partitionBy("conv").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = paths.select("conv", "d", *KEY, "sums").join(nodes.select(*KEY, "depth", "kids"), KEY, "left")
    steps = steps.withColumn("own", F.when(F.col("depth").isNotNull(), node)).withColumn("own", F.last("own", ignorenulls=True).over(down))
    prior = Window.partitionBy("conv").orderBy("d")
    steps = steps.withColumn("before", F.coalesce(F.lag("sums").over(prior), F.lit(0)))
    steps = stored(steps.select("conv", "d", "before", F.col("depth").isNotNull().alias("is_node"), "own.*"), "steps")

    # per node: members, smallest member, code points of its edge
    per = steps.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.sum(F.when(F.col("is_node"), 1).otherwise(0)).alias("n_convs"), F.min("before").alias("from"), F.first("sums").alias("to"))
    per = per.select(*KEY, "rep", "n_convs", ((F.col("n_convs") - 1) * (F.col("to") - F.col("from"))).alias("edge"))
    known = steps.join(per, KEY)
    mine = F.when(F.col("is_node") & (F.col("conv") == F.col("rep")), F.lit(1)).otherwise(0)
    known = known.withColumns({"_e": mine * F.col("edge"), "_l": mine * F.when(F.col("kids") == 0, 1).otherwise(0)})
    path, past = Window.partitionBy("conv"), prior.rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda x: F.sum(x).over(path) - F.coalesce(F.sum(x).over(past), F.lit(0))
    known = known.withColumns({"_se": rest("_e"), "_sl": rest("_l"), "parent": F.lag("rep").over(prior)})
    known = stored(known.select("conv", "d", "before", "is_node", *KEY, "sums", "kids", "rep", "n_convs", "edge", "_e", "_l", "_se", "_sl", "parent"), "known")
    below = known.where("is_node").groupBy(*KEY).agg(F.sum("_se").alias("sub"), F.sum("_sl").alias("n_leaves"))

    turnless = convs.select("conv").join(ends.select("conv"), "conv", "left_anti").select(F.lit(0).cast("long").alias("h0"), F.lit(0).cast("long").alias("h1"), "conv")
    listed = ends.select(*KEY, "conv").union(turnless).repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    digests = stored(listed.mapInArrow(_digest_ends, "h0 long, h1 long, ends_sha256 string"), "digests")

    rows = known.where("conv = rep").join(below, KEY).join(digests, KEY, "left")
    all_ = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()
    inside = ~F.col("is_node")
    body = rows.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.coalesce("parent", F.lit(all_["conv"]).cast("long")).alias("parent_conv_id"), F.col("n_convs").cast("long").alias("n_convs"),
                       F.when(inside, F.lit(1)).otherwise(F.col("kids")).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
                       (F.col("sub") - F.col("edge") + (F.col("n_convs") - 1) * (F.col("sums") - F.col("before"))).cast("long").alias("saved_tokens"),
                       F.when(inside | F.col("ends_sha256").isNull(), F.lit(EMPTY)).otherwise(F.col("ends_sha256")).alias("ends_sha256"))
    if not all_["n"]:
        return body
    total = known.agg(F.sum("_e").alias("saved"), F.sum("_l").alias("leaves")).first()
    own = digests.where("h0 = 0 and h1 = 0").first()
    root = (all_["conv"], 0, None, all_["n"], places.where("d = 1").count(), total["leaves"] or 1, total["saved"] or 0, own["ends_sha256"] if own else EMPTY)
    return body.union(spark.createDataFrame([root], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in body.schema)))


def contract_rebuild(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, convs) of the conversations that the query asks for: the first h turns of conversation c - c % 100, then the own turns after the first h."""
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6))
    tokens = stored(tokens, "turns")
    convs = tokens.where("d = 1").select("conv")
    head = tokens.where("d <= 5 and conv % 100 = 0").withColumnRenamed("conv", "base")
    size = head.groupBy("base").agg(F.max("d").alias("size"))
    based = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    first = based.where("h > 0").join(head, "base").where("d <= h").select("conv", "d", "t0", "t1", "chars")
    own = tokens.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100}).where("d > h").join(size, "base", "left")
    own = own.select("conv", (F.col("d") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).cast("long").alias("d"), "t0", "t1", "chars")
    return first.union(own), convs


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(*contract_rebuild(turn_tokens(spark.read.parquet(f"{folder}/conversations.parquet"))))


ORACLE = """with t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first) i from conversations where conv_id is not null),
f(n) as (select range from range(256)),
k(n, v) as (select n, list_reduce([n::bigint] || range(8), lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) from f),
tab as (select list(v order by n) v from k),
c as (select conv_id, conv_id - conv_id % 100 base, xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda z: ascii(z)::bigint),
   lambda a, b: xor(a >> 8, tab.v[xor(a & 255, b) + 1])), 4294967295) % 6 h from (select distinct conv_id from t), tab),
p as (select c.conv_id, t.i, t.r, t.x from c join t on t.conv_id = c.base and t.i <= c.h
  union all select c.conv_id, 10 + t.i, t.r, t.x from c join t on t.conv_id = c.conv_id and t.i > c.h),
s as (select conv_id, list({'r': r, 'x': x} order by i) q from p group by conv_id),
a as (select c.conv_id, coalesce(s.q, []) q from c left join s using (conv_id)),
e as (select conv_id, unnest(range(0, len(q) + 1)) d, q from a),
m as (select conv_id, d, md5(q[:d]::json::varchar) k, case when d > 0 then md5(q[:d - 1]::json::varchar) end pk, case when d > 0 then length(q[d].x) else 0 end n, d = len(q) last from e),
n as (select d, k, any_value(pk) pk, min(conv_id) conv_id, count(*) n_convs, any_value(n) n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) ends_sha256 from m group by d, k),
g as (select n.*, (select count(*) from n b where b.pk = n.k and b.d = n.d + 1) n_children from n),
u as (select m.k uk, m.d ud, g.d, g.n_children, (g.n_convs - 1) * g.n v from g join m on m.conv_id = g.conv_id and m.d <= g.d),
w as (select uk, ud, sum(v) saved, count(*) filter (n_children = 0) leaves from u group by uk, ud)
select g.conv_id, g.d::bigint as "depth", o.conv_id parent_conv_id, g.n_convs::bigint n_convs, g.n_children::bigint n_children, w.leaves::bigint n_leaves, w.saved::bigint saved_tokens, g.ends_sha256
from g join w on w.uk = g.k and w.ud = g.d left join n o on o.k = g.pk and o.d = g.d - 1"""
