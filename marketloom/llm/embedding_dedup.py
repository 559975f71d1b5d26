"""Near duplicates among embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import components, discard, drop_shuffles, small_batches, stored

LEAST = 0.95  # cosine of a link
NEIGHBOURS = 8  # length of a list at first; lists that are full of links grow
REVERSE = 8  # nodes that list a node, taken into one round of its local joins; another draw each round
WORDS = 4  # 64-bit words of a sketch; half as many lost links of wide groups
WINDOW = 12  # neighbours in the order of a sketch word that a list starts from
SETTLED = 0.05  # a descent ends when fewer of its list places change in a round
ROUNDS = 12
SALT = 16  # parts of a hot group
CHUNK = 256  # members of a ball that are compared at a time
AUDIT = 256  # vectors whose links are counted by brute force
RECALL = 0.99  # mean recall over the audited vectors below which the search goes on; below 0.9 at the end it is an error
SEED = 20250301

P, Q = [f"p{i}" for i in range(WORDS)], [f"q{i}" for i in range(WORDS)]


def unit_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, x array<double>) of the vectors that can link: an id, at least one component, none null or non-finite, not all zero. x has length 1."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    big = F.array_max(F.transform("x", F.abs))
    rows = vectors.where(F.col(id_column).isNotNull()).where(sound).select(F.col(id_column).cast("long").alias("id"), v.alias("x")).withColumn("_b", big).where("_b > 0")
    rows = rows.withColumn("x", F.transform("x", lambda c: c / F.col("_b")))  # so that no square leaves the range of doubles
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))
    return rows.withColumn("_n", length).select("id", F.transform("x", lambda c: c / F.col("_n")).alias("x"))


def cosine(a: str, b: str) -> Column:
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, c: s + c)).otherwise(-2.0)


def _sketches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Signs of random projections, 64 to a word: two vectors at an angle t differ in each bit with probability t / pi."""
    planes: dict[int, np.ndarray] = {}
    for b in batches:
        size = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(size).tolist():
            part = b.filter(pa.array(size == dim))
            if dim not in planes:
                planes[dim] = np.random.default_rng(seed + dim).standard_normal((dim, 64 * WORDS)).astype(np.float32)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            bits = np.packbits(x @ planes[dim] > 0, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("w"), part.column("x"), pa.array(np.full(len(x), dim), pa.int32()), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]], names=["id", "w", "x", "dim", *P])


def _windows(batches: Iterator[pa.RecordBatch], width: int, keep: int) -> Iterator[pa.RecordBatch]:
    """The nearest by sketch among the rows around each row, in the order the rows come in."""
    rest = None
    for b in batches:
        rows = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        n = rows.num_rows
        if n > 1:
            ids, dim = rows.column("id").to_numpy(), rows.column("dim").to_numpy()
            s = np.stack([rows.column(p).to_numpy() for p in P], 1).view(np.uint64)
            at = np.arange(n)
            near, far = [], []
            for k in range(1, min(width, n - 1) + 1):
                d = np.bitwise_count(s[k:] ^ s[:-k]).sum(1).astype(np.int32)
                d[dim[k:] != dim[:-k]] = 64 * WORDS + 1
                near += [np.append(d, np.full(k, 9_999, np.int32)), np.concatenate([np.full(k, 9_999, np.int32), d])]
                far += [at + k, at - k]
            near, far = np.stack(near, 1), np.stack(far, 1)
            best = np.argsort(near, axis=1, kind="stable")[:, :keep]
            i = np.repeat(at, best.shape[1])
            d, j = np.take_along_axis(near, best, 1).ravel(), np.take_along_axis(far, best, 1).ravel()
            ok = d <= 64 * WORDS
            i, j, d = i[ok], j[ok], d[ok]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(d), *[pa.array(s[r, k].view(np.int64)) for r in (i, j) for k in range(WORDS)]], names=["src", "dst", "dist", *P, *Q])
        rest = rows.slice(max(0, n - width))


EDGE = "src long, dst long, dist int, " + ", ".join(f"{c} long" for c in P + Q)


def start_lists(nodes: DataFrame, keep: int) -> DataFrame:
    """First lists: rows are sorted by the bits of their sketch, from another word on in each pass, and each meets its neighbours there."""
    out = None
    for k in range(WORDS):
        order = ["dim", *[f"p{(k + i) % WORDS}" for i in range(WORDS)], "id"]
        rows = nodes.select("id", "dim", *P).repartitionByRange(*order).sortWithinPartitions(*order)
        part = rows.mapInArrow(lambda it: _windows(it, WINDOW, keep), EDGE)
        out = part if out is None else out.union(part)
    return out


def _differ(a: list[str], b: list[str]) -> Column:
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0])))).cast("int")


def _cut_lists(edges: DataFrame) -> DataFrame:
    """One row per (src, dst), old ones first, and the `cap` nearest of each list; `worst` is what a new neighbour has to beat."""
    once = edges.repartition("src").groupBy("src", "dst").agg(F.min("fresh").alias("fresh"), F.max("cap").alias("cap"), *[F.first(c).alias(c) for c in ("dist", *P, *Q)])
    w = Window.partitionBy("src")
    kept = once.withColumn("cap", F.max("cap").over(w)).withColumn("_r", F.row_number().over(w.orderBy("dist", "dst"))).where("_r <= cap")
    full = F.count(F.lit(1)).over(w) >= F.col("cap")
    return kept.withColumn("worst", F.when(full, F.max("dist").over(w)).otherwise(64 * WORDS + 1)).drop("_r")


def descend(edges: DataFrame, seed: int) -> DataFrame:
    """Rounds of NN-descent until lists settle. edges: src, dst, dist, sketches, cap, fresh, worst.

    A node meets the lists of those it lists, and a bounded draw of the nodes that list them; pairs that met before are left out
    (one of the two edges must be new). Candidates that beat the end of its list enter it.
    """
    for round_ in range(ROUNDS):
        back = edges.select(F.col("dst").alias("node"), F.col("src").alias("nb"), F.col("fresh").alias("f2"), *[F.col(p).alias(f"n{i}") for i, p in enumerate(P)])
        draw = Window.partitionBy("node").orderBy(F.desc("f2"), F.xxhash64("nb", F.lit(seed + round_)))
        back = back.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= REVERSE).drop("_r")
        out = edges.select(F.col("src").alias("node"), F.col("dst").alias("nb"), F.col("fresh").alias("f2"), *[F.col(q).alias(f"n{i}") for i, q in enumerate(Q)])
        meet = edges.select("src", F.col("dst").alias("node"), "fresh", "cap", "worst", *P).join(out.union(back), "node").where("nb <> src and (fresh or f2)")
        names = [f"n{i}" for i in range(WORDS)]
        found = meet.withColumn("dist", _differ(P, names)).where("dist < worst").select("src", F.col("nb").alias("dst"), "dist", *P, *[F.col(n).alias(q) for n, q in zip(names, Q)], "cap", F.lit(True).alias("fresh"))
        old = edges.select("src", "dst", "dist", *P, *Q, "cap", F.lit(False).alias("fresh"))
        new = stored(_cut_lists(old.union(found)), "lists")
        discard(edges)
        edges = new
        drop_shuffles(edges.sparkSession)
        n = edges.agg(F.count(F.lit(1)), F.sum(F.when(F.col("fresh"), 1).otherwise(0))).first()
        if (n[1] or 0) <= SETTLED * n[0]:
            break
    return edges


def reach(angle) -> Column:
    """Bits in which sketches at an angle differ, six standard deviations up."""
    p = F.least(angle / math.pi, F.lit(0.5))
    return 64 * WORDS * p + 6 * F.sqrt(64 * WORDS * p * (1 - p))


def measured(edges: DataFrame, nodes: DataFrame, radius: DataFrame, least: float) -> DataFrame:
    """(a, b, cos, need, radii): pairs of lists whose sketches are near enough for a link between the balls of a < b, with their exact cosine. need: the
    cosine from which members of both balls can link; radii: the sum of the balls' angles."""
    theta = math.acos(least)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "dist").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    for side in "ab":
        pairs = pairs.join(radius.select(F.col("leader").alias(side), F.col("r").alias(f"r{side}")), side, "left")
    pairs = pairs.withColumn("radii", F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))).where(F.col("dist") <= reach(theta + F.col("radii")))
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("x").alias(f"x{side}")), side)
    need = F.when(F.col("radii") == 0, F.lit(least)).otherwise(F.cos(F.least(theta + F.col("radii"), F.lit(math.pi))) - 1e-9)
    return pairs.select("a", "b", cosine("xa", "xb").alias("cos"), need.alias("need"), "radii")


def cover(nodes: DataFrame, pairs: DataFrame, full: DataFrame, taken: DataFrame, half: float) -> DataFrame:
    """(id, leader, cos): balls over the linked groups that hold a saturated node. In each round the node of a group with the smallest hash that no ball
    holds yet leads, and the group's other such nodes within half the link angle join it; rounds go on while one in twenty joins. What is
    left stays in the graph. taken: nodes that lead or belong to balls already."""
    linked = pairs.where(F.col("cos") >= F.col("need")).select("a", "b")
    groups = stored(components(linked, "linked-groups"), "groups")
    hot = groups.join(full.select(F.col("src").alias("node")), "node", "left_semi").select("root").distinct()
    rest = groups.join(hot, "root", "left_semi").join(taken.withColumnRenamed("id", "node"), "node", "left_anti").join(nodes.select(F.col("id").alias("node"), "x"), "node").select(F.col("node").alias("id"), "root", "x")
    rounds, out = [], None
    while True:
        chief = rest.groupBy("root").agg(F.min(F.struct(F.xxhash64("id", F.lit(SEED)).alias("h"), "id", "x")).alias("c")).select("root", F.col("c.id").alias("leader"), F.col("c.x").alias("y"))
        chief = chief.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a group may hold a third of all nodes
        met = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(chief, ["root", "salt"])
        rounds.append(stored(met.select("id", "root", "x", "leader", cosine("x", "y").alias("cos")), "cover"))
        near = (F.col("cos") >= half) & (F.col("id") != F.col("leader"))
        n = rounds[-1].agg(F.count(F.lit(1)), F.sum(F.when(near, 1).otherwise(0)), F.sum(F.when(F.col("cos") < half, 1).otherwise(0))).first()
        got = rounds[-1].where(near).select("id", "leader", "cos")
        out = got if out is None else out.union(got)
        if not n[2] or 20 * n[1] < n[0]:
            break
        rest = rounds[-1].where((F.col("cos") < half) & (F.col("id") != F.col("leader"))).select("id", "root", "x")
    out = stored(out, "joined")
    discard(groups, *rounds)
    return out


def redirected(edges: DataFrame, joined: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lists after nodes have joined balls: their own lists go, and places that named one name its leader."""
    left = edges.join(joined.select(F.col("id").alias("src")), "src", "left_anti")
    to = joined.select(F.col("id").alias("dst"), F.col("leader").alias("to"))
    same = left.join(to, "dst", "left_anti").select("src", "dst", "dist", *P, *Q, "cap", "fresh")
    code = nodes.select(F.col("id").alias("dst"), *[F.col(p).alias(q) for p, q in zip(P, Q, strict=True)])
    turned = left.join(to, "dst").where("src <> to").select("src", F.col("to").alias("dst"), "cap", *P).join(code, "dst")
    return _cut_lists(same.union(turned.withColumn("dist", _differ(P, Q)).withColumn("fresh", F.lit(True)).select(*same.columns)))


def _ball_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per member of two chunks of balls, the weight of the other chunk's members that it links with."""
    for b in batches:
        for r in b.to_pylist():
            x, y = (np.array([m["x"] for m in r[k]]) for k in ("ma", "mb"))
            link = x @ y.T >= least
            wa, wb = (np.array([m["w"] for m in r[k]], np.int64) for k in ("ma", "mb"))
            out = [(r["a"], r["b"], m["id"], n) for m, n in zip(r["ma"], (link @ wb).tolist()) if n] + [(r["a"], r["b"], m["id"], n) for m, n in zip(r["mb"], (wa @ link).tolist()) if n]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "id", "n"])


def count_links(pairs: DataFrame, nodes: DataFrame, members: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """((id, n) links of each node with all others, (a, b) balls between which a link exists). Members of one ball link with one another, and so do those of
    two balls whose angle and radii stay below the link angle. Pairs of single nodes are known. Other balls are compared in chunks, exactly, and
    only counts per member leave a task."""
    of = nodes.join(members.select("id", "leader"), "id", "left").select("id", "w", "x", F.coalesce("leader", "id").alias("ball"))
    size = stored(of.groupBy("ball").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("total")), "balls")
    near = pairs.where(F.col("cos") >= F.col("need"))
    for side in "ab":
        near = near.join(size.select(F.col("ball").alias(side), F.col("k").alias(f"k{side}"), F.col("total").alias(f"t{side}")), side)
    theta = math.acos(least)
    sure = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.col("cos") >= least).otherwise(F.acos(F.least("cos", F.lit(1.0))) + F.col("radii") <= theta - 1e-9)
    near = stored(near.withColumn("sure", sure).where("sure or ka > 1 or kb > 1"), "near-balls")
    whole = near.where("sure")
    whole = whole.select(F.col("a").alias("ball"), F.col("tb").alias("n")).union(whole.select("b", "ta")).union(size.select("ball", "total")).groupBy("ball").agg(F.sum("n").alias("n"))
    open_ = near.where("not sure").select("a", "b")
    used = open_.select(F.col("a").alias("ball")).union(open_.select("b")).distinct()
    chunks = of.join(used, "ball", "left_semi").join(size.select("ball", "k"), "ball").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / CHUNK)))
    chunks = stored(chunks.groupBy("ball", "part").agg(F.collect_list(F.struct("id", "w", "x")).alias("m")), "chunks")
    met = open_.join(chunks.select(F.col("ball").alias("a"), F.col("m").alias("ma")), "a").join(chunks.select(F.col("ball").alias("b"), F.col("m").alias("mb")), "b")
    with small_batches(nodes.sparkSession, 16):
        found = stored(met.mapInArrow(lambda it: _ball_links(it, least), "a long, b long, id long, n long"), "ball-links")
    own = of.join(whole, "ball").select("id", (F.col("n") - 1).alias("n"))
    links = stored(own.union(found.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n")), "links")
    joins = stored(near.where("sure").select("a", "b").union(found.select("a", "b").distinct()), "joins")
    discard(near, chunks, found, size)
    return links, joins


def audit(nodes: DataFrame, counted: DataFrame, least: float, sample: int = AUDIT) -> float | None:
    """Mean share of their links found over audited nodes that have any (equal vectors are one node); None if none has. The audited are the `sample` (bounded) smallest by hash,
    half of them among vectors with links, and each is compared with every vector."""
    some = nodes.join(counted.where("n > 0").select("id"), "id", "left_semi")
    ids = [{r["id"] for r in d.select("id").orderBy(F.xxhash64("id"), "id").limit(sample // 2).collect()} for d in (some, nodes)]
    ids = sorted(ids[0] | ids[1])
    rows = nodes.where(F.col("id").isin(ids)).select("id", "x").collect() if ids else []
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["x"]), []).append(r)
    probes = {d: (np.array([r["id"] for r in v]), np.array([r["x"] for r in v])) for d, v in by_dim.items()}

    def scan(batches):
        for b in batches:
            size = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for dim, (who, x) in probes.items():
                part = b.filter(pa.array(size == dim))
                if part.num_rows:
                    y = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    near = y @ x.T >= least
                    n = part.column("w").to_numpy() @ near
                    yield pa.RecordBatch.from_arrays([pa.array(who[n > 0]), pa.array(n[n > 0])], names=["id", "links"])

    known = nodes.select("id", "w", "x").mapInArrow(scan, "id long, links long").groupBy("id").agg((F.sum("links") - 1).alias("links")).where("links > 0")
    return known.join(counted, "id", "left").agg(F.avg(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / F.col("links")))).first()[0]


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = LEAST) -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= least that were found), component_id (smallest id reachable by links, itself included), kept (vec_id = component_id).

    1. Equal unit vectors are one node with a weight, so a group of exact copies is one entry of one list.
    2. Lists start from neighbours in the order of sketch words (signs of random projections) and are refined by NN-descent.
    3. Pairs whose sketches can belong to a link get their exact cosine. Full lists that are links by half and end where sketches of links
       can still lie are saturated: their nodes are gathered
       into balls of half the link angle, whose members all link, and leave one leader in the graph; where no ball forms
       their lists double. Then the descent goes on, until no list is saturated.
    4. Links between balls are counted exactly in chunks; nothing is emitted per pair. A group much wider than a ball costs all its pairs in arithmetic.
    5. A bounded set of vectors is compared with all others. If recall is below RECALL the whole search is done again with longer lists and other sketches;
       if it stays below 0.9 an error is raised.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their own id; a null id has no component and is
    not kept. Vectors of different lengths do not link. Rows that repeat an id and a vector are one row; an id with several
    vectors has their links together. Other columns are ignored. An empty table gives no rows.
    """
    unit = unit_vectors(vectors, id_column, column).select("id", F.xxhash64("x").alias("node"), F.xxhash64(F.lit(1), "x").alias("k"), "x")
    unit = stored(unit.groupBy("id", "node", "k").agg(F.first("x").alias("x")), "unit-vectors")
    heads = stored(unit.groupBy("node", "k").agg(F.count(F.lit(1)).alias("w"), F.first("x").alias("x")).select(F.col("node").alias("id"), "w", "x"), "heads")
    for attempt in range(3):
        counted, joins, members = _search(heads, least, NEIGHBOURS << attempt, SEED + 1000 * attempt)
        recall = audit(heads, counted, least)
        if recall is None or recall >= RECALL:
            break
    else:
        if recall < 0.9:
            raise RuntimeError(f"recall of the neighbour search is {recall:.3f}")
    belongs = unit.select("id", "node").join(members.select(F.col("id").alias("node"), "leader"), "node", "left").withColumn("leader", F.coalesce("leader", "node"))
    belongs = stored(belongs, "belongs")
    several = belongs.groupBy("id").agg(F.min("leader").alias("a"), F.max("leader").alias("z")).where("a < z").select("id", "a")
    edges = joins.union(several.join(belongs, "id").select("a", "leader"))
    roots = stored(components(edges, "vector-groups"), "vector-roots")
    named = belongs.join(roots.select(F.col("node").alias("leader"), "root"), "leader", "left").select("id", "node", F.coalesce("root", "leader").alias("root"))
    least_id = named.groupBy("root").agg(F.min("id").alias("component_id"))
    result = named.join(least_id, "root").join(counted.select(F.col("id").alias("node"), "n"), "node")
    result = result.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col(id_column).cast("long").alias("vec_id")).distinct()
    out = ids.join(result.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _search(heads: DataFrame, least: float, cap: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links per node, ball pairs that link, members of balls) over the nodes (id, w, x)."""
    half = math.cos(math.acos(least) / 2) + 1e-12
    nodes = stored(heads.select("id", "w", "x").mapInArrow(lambda it: _sketches(it, seed), "id long, w long, x array<double>, dim int, " + ", ".join(f"{p} long" for p in P)), "sketches")
    first = start_lists(nodes, cap)
    edges = stored(_cut_lists(first.withColumns({"cap": F.lit(cap), "fresh": F.lit(True)})), "lists")
    members = stored(nodes.select("id", F.col("id").alias("leader"), F.lit(1.0).alias("cos")).where("false"), "members")
    turn = 0
    while True:
        edges = descend(edges, seed + 100 * turn)
        radius = members.groupBy("leader").agg(F.max(F.acos(F.least("cos", F.lit(1.0)))).alias("r"))
        pairs = stored(measured(edges, nodes, radius, least), "pairs")
        linked = pairs.where("cos >= need")
        linked = linked.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).alias("l")).union(linked.select("b", "a", F.lit(1)))
        widest = math.acos(least) + 2 * (radius.agg(F.max("r")).first()[0] or 0.0)
        full = edges.select("src", "dst", "dist", "cap").join(linked, ["src", "dst"], "left").groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.sum("l").alias("l"), F.max("dist").alias("end"), F.first("cap").alias("cap"))
        full = stored(full.where("k >= cap and 2 * l >= k").where(F.col("end") <= reach(F.lit(widest))).select("src"), "saturated")
        if full.isEmpty():
            discard(full)
            break
        joined = cover(nodes, pairs, full, members.select(F.col("leader").alias("id")).distinct(), half)
        old, was = edges, members
        if joined.isEmpty():
            grown = edges.join(full.withColumn("more", F.lit(True)), "src", "left").withColumn("cap", F.when(F.col("more"), F.col("cap") * 2).otherwise(F.col("cap")))
            edges = stored(_cut_lists(grown.drop("more", "worst").withColumn("fresh", F.col("cap") > cap)), "lists")
        else:
            members = stored(was.union(joined), "members")
            edges = stored(redirected(edges, joined, nodes), "lists")
            discard(was)
        discard(old, pairs, full, joined)
        turn += 1
    counted, joins = count_links(pairs, nodes, members, least)
    discard(edges, pairs)
    return counted, joins, members


def op11_embedding_dedup(spark, folder: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
