"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._arrays import bitmap, byte_class, find, grams, mix, release, slices, utf8, word_bounds, word_hashes
from ._store import components, discard, small_batches, stored

SHINGLE = 5
PERCENT = 75
MATCHES = 5  # longest extension of a prefix, in tokens
HEAVY = 12  # documents that make a token heavy
HEAVY_KEPT = 1 << 19  # the most frequent heavy tokens that are ordered by count; the rest are ordered by hash
BUCKET_TOKENS = 2_000_000  # tokens of all texts a bucket
HELD = 1_000_000  # tokens a task gathers before it sends them on
SKETCH = 1024  # bits of the widest sketch of a set
SEEN = 1 << 18  # fingerprints a task remembers to post a copied set once
WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)])
LOW32 = np.uint64(0xFFFFFFFF)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles (fewer words: the whole sequence as one)."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets, WORD)
    words = word_hashes(data, starts, ends)
    all_grams, out = grams(words, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        g = all_grams[a:b - n + 1] if b - a >= n else grams(words[a:b], b - a) if b > a else all_grams[:0]
        g = np.sort(g)
        out.append(g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g)
    return out


def set_id(s: np.ndarray) -> int:
    """Fingerprint of a set as a signed 64-bit integer."""
    total = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0
    return int(mix(np.array([total ^ len(s) * 0x2545F4914F6CDD1D & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens by hash, as 64-bit words: two to four bits a token, 256 at least and SKETCH at most.

    Tokens that two sets share cancel in the exclusive or of their sketches, so its ones are at most as many as the tokens that only one of them holds."""
    bits = min(SKETCH, max(256, 1 << (2 * len(s) - 1).bit_length()))
    at = (mix(s ^ np.uint64(0x2127599BF4325C37)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, axis=None, bitorder="little").view("<i8") if len(s) else np.zeros(0, np.int64)


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (((tokens >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _key(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix((bucket.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64))


def _sizes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = shingle_sets(b.column("text"), n)
        words = [sketch(s) for s in sets]
        sketches = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32)), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()), sketches], names=["doc_id", "n", "sid", "sketch"])


def _token_counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Tokens as 32-bit numbers with their counts, by bucket: what the count of documents per token needs."""
    held, size = [], 0

    def flush():
        t, count = np.unique(np.concatenate(held), return_counts=True)  # a token that many texts hold is one entry
        own = _bucket(t, buckets)
        cut = np.flatnonzero(np.diff(own, prepend=-1))
        low, many, more = (t & LOW32).astype(np.uint32), np.flatnonzero(count > 1), (count - 1).astype(np.uint32)
        bounds = [*cut.tolist(), len(t)]
        blobs = [low[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        inside = np.searchsorted(many, bounds)
        extra = [low[many[a:b]].tobytes() + more[many[a:b]].tobytes() for a, b in zip(inside, inside[1:])]
        return pa.RecordBatch.from_arrays([pa.array(own[cut].astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(extra, pa.binary())], names=["bucket", "tokens", "more"])

    for b in slices(batches):
        for s in shingle_sets(b.column("text"), n):
            held.append(s)
            size += len(s)
        if size >= HELD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _heavy(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    t = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["tokens"]]))
    cut = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    count = np.diff(cut, append=len(t))
    for blob in pdf["more"]:  # tokens, then how often they occurred beyond the first time
        token, times = np.frombuffer(blob, np.uint32).reshape(2, -1)
        count[np.searchsorted(t[cut], token)] += times
    cut, count = cut[count >= least], count[count >= least]
    return pd.DataFrame({"bucket": np.full(len(cut), pdf["bucket"].iloc[0], np.int32), "token": t[cut].astype(np.int64), "cnt": count.astype(np.int64)})


def prefix(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT, most: int = MATCHES) -> tuple[np.ndarray, int]:
    """Order of a set's tokens (rare first) cut at its prefix, and how many shared prefix tokens a partner must have.

    With overlap of at least a = ceil(t n), the first n - a + l tokens of two linked sets share l or more. Each further token costs
    its posting list, but asks for one more match: l minimises postings read plus the verification of those that can reach l.
    """
    n = len(s)
    light = np.flatnonzero(counts == 0)
    rest = np.flatnonzero(counts)
    order = np.concatenate([light, rest[np.lexsort((s[rest], counts[rest]))]])
    least = -(-percent * n // 100)
    top = min(most, least)
    cost = np.cumsum(np.maximum(counts[order] - 1, 0))[n - least:n - least + top]
    l = np.arange(1, top + 1)
    best = int(l[np.argmin(l + cost * (1 + n / (16 * l)))])
    return order[:n - least + best], best


def _postings(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Prefix tokens by bucket. A task posts equal sets once; heavy tokens are dealt one by one, so copies in many tasks meet in no crowded bucket."""
    keys, counts, seen = heavy
    held: list[tuple] = []
    posted: set[int] = set()
    size = 0

    def flush():
        token, sid, m, pos, l, cnt = (np.concatenate(x) for x in zip(*held, strict=True))
        own = _bucket(token, buckets)
        to = np.where(cnt > 0, (mix(token ^ mix(sid.view(np.uint64))) % np.uint64(buckets)).astype(np.int64), own)  # heavy tokens only pass through
        order = np.lexsort((cnt > 0, to))
        group = to[order] * 2 + (cnt[order] > 0)
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        low, high = (token & LOW32).astype(np.uint32).view(np.int32)[order], own[order].astype(np.int32)
        ends = np.append(cut, len(order)).astype(np.int32)
        column = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
        thin = cnt[order][cut] == 0
        highs = [None if t else high[a:b] for t, a, b in zip(thin, ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((group[cut] // 2).astype(np.int32)), pa.array(highs, pa.list_(pa.int32())), column(low), column(sid[order]), column(m[order].astype(np.int32)),
                                           column(pos[order].astype(np.int32)), column(l[order].astype(np.int8))], names=["bucket", "high", "token", "sid", "n", "pos", "l"])

    for b in slices(batches):
        sets = shingle_sets(b.column("text"), n)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        cnt = np.zeros(len(flat), np.int64)
        if len(keys) and len(flat):
            at, where = find(_key(_bucket(flat, buckets), flat & LOW32), keys, seen)
            cnt[at] = counts[where]
        done = 0
        for s in sets:
            c = cnt[done:done + len(s)]
            done += len(s)
            if len(s) and (sid := set_id(s)) not in posted:
                if len(posted) >= SEEN:
                    posted.clear()
                posted.add(sid)
                order, l = prefix(s, c, percent)
                m = len(order)
                held.append((s[order], np.full(m, sid), np.full(m, len(s)), np.arange(m), np.full(m, l), c[order]))
                size += m
        if size >= HELD // 4:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Postings of a bucket whose token occurs in two sets at least; heavy ones pass."""
    parts = []
    for heavy, rows in pdf.groupby(pdf["high"].notna()):
        low = np.concatenate(rows["token"].to_numpy()).view(np.uint32).astype(np.int64)
        high = np.concatenate(rows["high"].to_numpy()).astype(np.int64) if heavy else np.full(len(low), pdf["bucket"].iloc[0], np.int64)
        f = pd.DataFrame({"key": (high << 32) | low, "heavy": heavy} | {c: np.concatenate(rows[c].to_numpy()) for c in ("sid", "n", "pos", "l")})
        if not heavy:
            f = f[f["key"].duplicated(keep=False)].drop_duplicates(["key", "sid"])
            f = f[f["key"].duplicated(keep=False)]
        parts.append(f)
    release()
    return pd.concat(parts)


def _need(a: str, b: str, percent: int) -> str:
    return f"ceil({percent} * ({a}.n + {b}.n) / {100 + percent})"


def _fits(a: str, b: str, percent: int) -> str:
    """Two postings can be a linked pair's first l common tokens: sizes and remaining tokens allow the overlap (n, pos, l columns)."""
    need = _need(a, b, percent)
    l = f"least({a}.l, {b}.l)"
    return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {a}.n - {a}.pos >= {need} - {l} + 1 and {b}.n - {b}.pos >= {need} - {l} + 1")


def _close(a: str, b: str, percent: int) -> str:
    """Two sketches allow the overlap (n, sketch columns). The wider one is folded; sizes that link differ by less than a factor of two in width."""
    width = f"least(size({a}.sketch), size({b}.sketch))"
    word = lambda x: f"(get({x}.sketch, i) ^ if(size({x}.sketch) > {width}, get({x}.sketch, i + {width}), 0L))"
    return f"aggregate(sequence(0, {width} - 1), 0, (d, i) -> d + bit_count({word(a)} ^ {word(b)})) <= {a}.n + {b}.n - 2 * {_need(a, b, percent)}"


def _only(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    bits = np.uint64(64 - (len(wanted).bit_length() - 1))
    for b in batches:
        ids = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        keep = wanted[(mix(np.nan_to_num(ids).astype(np.int64).view(np.uint64)) >> bits).astype(np.int64)]
        yield b.filter(pa.array(keep))


def _doc_bits(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A fixed-size bitmap of document ids (2 MB packed); it only thins a scan before an exact join."""
    def fold(batches):
        out = np.zeros(1 << bits, bool)
        for b in batches:
            out |= bitmap(mix(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), bits)
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(out).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << bits, bool)
    for r in ids.coalesce(8).mapInArrow(fold, "bits binary").toLocalIterator():
        total |= np.unpackbits(np.frombuffer(r[0], np.uint8)).view(bool)
    return total


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Exact test of each member against its group's pivot. Rows come sorted by group, the pivot first; groups are small and many, so they share batches."""
    group, pivot = None, None
    for b in slices(batches):
        hubs, parts, ids, first = (b.column(k).to_pylist() for k in ("hub", "part", "sid", "is_hub"))
        found = []
        for s, hub, part, sid, is_hub in zip(shingle_sets(b.column("text"), n), hubs, parts, ids, first, strict=True):
            if is_hub:
                group, pivot = (hub, part), s
            elif group == (hub, part) and len(s) and len(pivot):
                at = np.searchsorted(pivot, s)
                at[at == len(pivot)] = 0
                common = int((pivot[at] == s).sum())
                if 100 * common >= percent * (len(s) + len(pivot) - common):
                    found.append((hub, sid))
        a, c = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def links(documents: DataFrame, ids: DataFrame, pairs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Those (hub, sid) pairs whose sets link. Members of a hub are dealt into parts of bounded size, each with the hub's text."""
    size = pairs.join(ids.select("sid", F.col("n").alias("m")), "sid")
    parts = stored(size.groupBy("hub").agg(F.ceil(F.sum("m") / 500_000).cast("int").alias("parts")), "parts")  # stored, so the next join can split a hot hub
    member = pairs.join(parts, "hub").select("hub", "sid", (F.pmod(F.xxhash64("sid"), F.col("parts"))).cast("int").alias("part"), F.lit(False).alias("is_hub"))
    hubs = parts.select("hub", F.col("hub").alias("sid"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"))
    want = stored(member.union(hubs).join(ids.select("sid", "doc_id"), "sid"), "wanted")
    discard(parts)
    bits = documents.sparkSession.sparkContext.broadcast(_doc_bits(want.select("doc_id")))
    texts = documents.select("doc_id", "text").mapInArrow(lambda it: _only(it, bits.value), "doc_id long, text string")
    rows = texts.join(want.hint("merge"), "doc_id").select("hub", "part", "sid", "is_hub", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))
    return rows.mapInArrow(lambda it: _verify(it, n, percent), "a long, b long"), want


def near_duplicates(documents: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    1. Every text becomes a set of shingle hashes with a 64-bit fingerprint; equal sets are one node from here on.
    2. Documents per token are counted over all texts (32-bit tokens in buckets whose number follows the input). The most frequent
       tokens order the prefixes, rare first; the bound on their number changes the cost, never the result.
    3. Each set sends its adaptive prefix, once a task however many copies it has; postings that two sets share remain.
    4. Star round: each set is verified against the one leader (the set that holds the token earliest) it shares most with. Linked
       sets merge into components, so a group of copies costs one pair a member.
    5. Remainder: all pairs that share enough prefix tokens and still lie in different components are verified. Their sketches are compared in the
       join, so that of many sets with common tokens only the pairs that can link leave it.

    documents: doc_id long, text string; other columns are ignored. Null, empty and blank texts have no shingles and stay alone;
    repeated rows come out repeated; a row with a null doc_id keeps a null component_id unless its set has an id.
    """
    with small_batches(documents.sparkSession):
        return _near_duplicates(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), n, percent)


def _near_duplicates(documents: DataFrame, n: int, percent: int) -> DataFrame:
    spark = documents.sparkSession
    sets = stored(documents.mapInArrow(lambda it: _sizes(it, n), "doc_id long, n long, sid long, sketch array<long>"), "sets")
    ids = sets.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    buckets = max(1, -(-(sets.agg(F.sum("n")).first()[0] or 0) // BUCKET_TOKENS))
    texts = documents.where("doc_id is not null")
    counted = texts.select("text").mapInArrow(lambda it: _token_counts(it, n, buckets), "bucket int, tokens binary, more binary")
    counted = counted.groupBy("bucket").applyInPandas(lambda pdf: _heavy(pdf, HEAVY), "bucket int, token long, cnt long")
    top = counted.orderBy(F.desc("cnt"), "bucket", "token").limit(HEAVY_KEPT).toPandas()
    keys = _key(top["bucket"].to_numpy(np.int64), top["token"].to_numpy(np.int64))
    order = np.argsort(keys)
    heavy = spark.sparkContext.broadcast((keys[order], top["cnt"].to_numpy(np.int64)[order], bitmap(keys)))
    posted = texts.select("text").mapInArrow(lambda it: _postings(it, n, percent, buckets, heavy.value),
                                             "bucket int, high array<int>, token array<int>, sid array<long>, n array<int>, pos array<int>, l array<byte>")
    shared = posted.groupBy("bucket").applyInPandas(_shared, "key long, heavy boolean, sid long, n int, pos int, l byte")
    raw = stored(shared, "shared")
    shared = stored(raw.where("heavy").distinct().union(raw.where("not heavy")), "postings")  # copies in several tasks repeat heavy postings
    discard(raw)

    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("sid"), F.lit(8))).otherwise(0)
    lead = shared.groupBy("key", salt.alias("salt")).agg(F.min(F.struct("pos", "sid", "n", "l")).alias("x")).select("key", "x.*")
    star = shared.alias("a").join(lead.alias("b"), F.expr(f"a.key = b.key and a.sid <> b.sid and {_fits('a', 'b', percent)}"))
    star = star.groupBy("a.sid", F.col("b.sid").alias("hub")).agg(F.count(F.lit(1)).alias("c"))
    star = stored(star.groupBy("sid").agg(F.max(F.struct("c", "hub")).alias("x")).select("sid", "x.hub"), "stars")
    edges, want = links(documents, ids, star, n, percent)
    edges = stored(edges, "edges")
    discard(star, want)

    merged = stored(components(edges), "merged")
    owned = shared.join(merged.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sizes = owned.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    rank = (F.row_number().over(Window.partitionBy("key").orderBy(F.desc("size"), "root")) - 1).alias("rank")  # the largest root of a key is 0
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key")
    ranked = sizes.join(mixed, "key", "left_semi").select("key", "root", rank)
    sketches = sets.where("n > 0 and doc_id is not null").select("sid", "sketch").dropDuplicates(["sid"])
    owned = stored(owned.join(ranked, ["key", "root"]).join(sketches, "sid"), "owned")
    # a set of a smaller root probes every larger root of its key: sets of one root never meet
    probes = owned.where("rank > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rank") - 1)))
    rest = probes.alias("a").join(owned.alias("b"), F.expr(f"a.key = b.key and a.other = b.rank and {_fits('a', 'b', percent)} and {_close('a', 'b', percent)}"))
    rest = rest.groupBy(F.expr("least(a.sid, b.sid)").alias("hub"), F.expr("greatest(a.sid, b.sid)").alias("sid")).agg(F.count(F.lit(1)).alias("c"), F.first(F.expr("least(a.l, b.l)")).alias("l"))
    rest = stored(rest.where("c >= l").select("hub", "sid"), "rest")
    more, want = links(documents, ids, rest, n, percent)
    more = stored(more, "edges")
    discard(rest, want, owned, shared)
    final = stored(components(edges.union(more)), "final")
    discard(edges, more, merged)

    roots = ids.join(final.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(smallest, "root").select("sid", "component_id")
    return sets.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
