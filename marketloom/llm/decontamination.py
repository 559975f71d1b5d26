"""Benchmark decontamination with suffix arrays over training shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import bitmap, byte_class, find, grams, ragged, slices, utf8, word_bounds, word_hashes

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
WORD[65:91] = True  # A-Z are lower-cased first
OUT = "n_words long, n_hit long, items array<string>, longest_match long, longest_item string, longest_start long, hit_spans array<struct<start:long,stop:long>>"


@dataclass
class TestSuffixes:
    """Every suffix of a block of test items, cut at the window: one row of word hashes each (0 after the item's end)."""

    rows: np.ndarray
    need: np.ndarray  # words that make an occurrence of a window here; 0 where no window starts
    item: np.ndarray
    at: np.ndarray
    words: np.ndarray
    left: np.ndarray  # words from here to the item's end
    names: list[str]
    seed: int
    seeds: np.ndarray
    seen: np.ndarray
    window: np.ndarray  # one suffix for each distinct window
    bounds: np.ndarray  # of a window's items in `members`
    members: np.ndarray


def _columns(words: np.ndarray, at: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """Words at.. of each suffix as a row; 0 from its text's end on."""
    pos = at[:, None] + np.arange(width)
    return np.where(pos < stop[:, None], words[np.minimum(pos, max(len(words) - 1, 0))], 0)


def suffixes_of(names: list[str], texts: list[str], window: int) -> TestSuffixes:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = word_bounds(data, offsets, WORD)
    words = word_hashes(data, starts, ends)
    count = np.diff(first)
    item = np.repeat(np.arange(len(names)), count)
    at = np.arange(len(words))
    stop = first[1:][item]
    left = stop - at
    need = np.where(left >= window, window, np.where((at == first[:-1][item]) & (count[item] < window), left, 0))
    seed = int(min(4, count[count > 0].min())) if len(words) else 1
    keys = grams(words, seed)
    seeds = np.unique(keys[left[:len(keys)] >= seed])
    rows = _columns(words, at, stop, window)
    real = np.flatnonzero(need)
    key = np.where(np.arange(window) < need[real][:, None], rows[real], 0)
    _, one, group = np.unique(np.column_stack([key, need[real].astype(np.uint64)]), axis=0, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([group.ravel(), item[real]], 1), axis=0) if len(real) else np.zeros((0, 2), np.int64)
    bounds = np.searchsorted(pairs[:, 0], np.arange(len(one) + 1))
    return TestSuffixes(rows, need, item, at, words, left, names, seed, seeds, bitmap(seeds), real[one], bounds, pairs[:, 1])


def _less(rows: np.ndarray, keys: np.ndarray, or_equal: bool) -> np.ndarray:
    differs = rows != keys
    at = differs.argmax(1)
    i = np.arange(len(rows))
    return np.where(differs[i, at], rows[i, at] < keys[i, at], or_equal)


def bisect(rows: np.ndarray, keys: np.ndarray, right: bool = False) -> np.ndarray:
    """Binary search of every key row in lexicographically sorted rows."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(rows), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        up = open_ & _less(rows[np.minimum(mid, len(rows) - 1)], keys, right)
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], (~same).argmax(1))


def shard_matches(words: np.ndarray, first: np.ndarray, tests: TestSuffixes, window: int):
    """Suffix array of one shard, searched for every test suffix.

    Returns the occurrences of distinct windows (document word position, length, window) and for each test suffix its longest match and where.
    Only suffixes that begin with a test seed are sorted: no other can hold a whole window.
    """
    stop = np.repeat(first[1:], np.diff(first))
    keys = grams(words, tests.seed)
    at, _ = find(keys, tests.seeds, tests.seen)
    at = at[stop[at] - at >= tests.seed]
    if not len(at):
        return np.zeros((3, 0), np.int64), np.zeros(len(tests.at), np.int64), np.zeros(len(tests.at), np.int64)
    rows = _columns(words, at, stop[at], window)
    order = np.lexsort(rows.T[::-1])
    rows, at = rows[order], at[order]
    low = bisect(rows, tests.rows)
    longest, where = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    for side in (np.maximum(low - 1, 0), np.minimum(low, len(rows) - 1)):
        n = _common(rows[side], tests.rows)
        better = n > longest
        longest, where = np.where(better, n, longest), np.where(better, at[side], where)
    full = np.flatnonzero(longest == window)  # longer matches go on word by word
    p, q, grow = where[full] + window, tests.at[full] + window, np.ones(len(full), bool)
    room = np.minimum(stop[where[full]] - p, tests.left[full] - window)
    k = 0
    while (grow := grow & (k < room)).any():
        grow = grow & (words[np.minimum(p + k, len(words) - 1)] == tests.words[np.minimum(q + k, len(tests.words) - 1)])
        longest[full[grow]] += 1
        k += 1
    group = np.flatnonzero(longest[tests.window] >= tests.need[tests.window])
    real = tests.window[group]
    inside = np.arange(window) < tests.need[real][:, None]
    lo = bisect(rows, np.where(inside, tests.rows[real], 0))
    hi = bisect(rows, np.where(inside, tests.rows[real], np.uint64((1 << 64) - 1)), right=True)
    hits = ragged(lo, hi - lo)
    return np.stack([at[hits], np.repeat(tests.need[real], hi - lo), np.repeat(group, hi - lo)]), longest, where


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and the first word of each text (with one more at the end)."""
    data, offsets = utf8(column)
    starts, ends, first = word_bounds(data, offsets, WORD)
    return word_hashes(data, starts, ends), first


def _marks(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _scan(tests: TestSuffixes, window: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", SHARD_BYTES):
        words, first = _words(b.column("text"))
        (at, length, group), longest, where = shard_matches(words, first, tests, window)
        spans = b.column("hit_spans").to_pylist()
        row = np.searchsorted(first, at, "right") - 1
        for r in np.flatnonzero(np.array([bool(s) for s in spans])):  # hits of earlier blocks
            at = np.concatenate([at, [first[r] + s["start"] for s in spans[r]]])
            length = np.concatenate([length, [s["stop"] - s["start"] for s in spans[r]]])
        hit = _marks(len(words), at, length)
        cut = first[(first > 0) & (first < len(words))]
        both = cut[hit[cut] & hit[cut - 1]]
        up = np.sort(np.concatenate([np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0) > 0), both]))
        down = np.sort(np.concatenate([np.flatnonzero(np.diff(hit.astype(np.int8), append=0) < 0) + 1, both]))
        n_hit = np.bincount(np.searchsorted(first, np.flatnonzero(hit), "right") - 1, minlength=b.num_rows)
        items, span_row = [set(x or ()) for x in b.column("items").to_pylist()], np.searchsorted(first, up, "right") - 1
        for r, g in np.unique(np.stack([row, group]), axis=1).T if len(row) else ():
            items[r].update(tests.names[i] for i in tests.members[tests.bounds[g]:tests.bounds[g + 1]])
        new_spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
        for r, u, d in zip(span_row, up, down, strict=True):
            new_spans[r].append({"start": int(u - first[r]), "stop": int(d - first[r])})
        best = [list(x) for x in zip(b.column("longest_match").to_pylist(), b.column("longest_item").to_pylist(), b.column("longest_start").to_pylist(), strict=True)]
        for k in np.flatnonzero(longest):
            r = int(np.searchsorted(first, where[k], "right") - 1)
            if longest[k] > best[r][0]:
                best[r] = [int(longest[k]), tests.names[tests.item[k]], int(where[k] - first[r])]
        cols = {"n_words": np.diff(first), "n_hit": n_hit, "items": [sorted(x) for x in items], "longest_match": [x[0] for x in best],
                "longest_item": [x[1] for x in best], "longest_start": [x[2] for x in best], "hit_spans": new_spans}
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else b.column(f.name).cast(f.type) for f in schema], schema=schema)


def _blocks(benchmark: DataFrame, size: int) -> Iterator[tuple[list[str], list[str]]]:
    names, texts, held = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null and text is not null").toLocalIterator():
        names.append(r[0])
        texts.append(r[1])
        held += len(r[1])
        if held >= size:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Verbatim matches of every test item in every document.

    A shard is a run of documents of about 4 MB inside a task. Its suffix array (word positions sorted by the words that follow) is
    binary-searched for every suffix of every test item, which yields the longest match and all places of whole windows. Test items
    are the stated query set: they are read in blocks of `block_bytes`, each shipped to the tasks and applied in one chained pass.

    documents: text string and the columns of `keep`; benchmark: item_id, text. Rows with a null item_id or text are no items; items
    with one id count once. A null or empty document has no words and no hit; repeated rows come out repeated. `items` are the ids with
    an occurring window sorted as strings; `longest_*` the longest match found at a document (ties: first in item order), null without
    one; it is complete from four words on. Columns of `documents` that are not in `keep` are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = documents.select(*keep, F.col("text").cast("string").alias("text")).selectExpr(
        "*", "0L n_words", "0L n_hit", "cast(array() as array<string>) items", "0L longest_match", "cast(null as string) longest_item", "cast(null as long) longest_start",
        "cast(array() as array<struct<start:long,stop:long>>) hit_spans")
    schema = out.schema
    for names, texts in [*_blocks(benchmark, block_bytes)] or [([], [])]:
        tests = documents.sparkSession.sparkContext.broadcast(suffixes_of(names, texts, window))
        arrow = to_arrow_schema(schema)
        out = out.mapInArrow(lambda batches, t=tests, a=arrow: _scan(t.value, window, a, batches), schema)
    return out.drop("text")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`matches` with the decision: contaminated when at least one word in twenty lies inside an occurrence of a window."""
    return matches(documents, benchmark, window, keep=keep).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _clean(tests: TestSuffixes, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents that are not contaminated; only verdicts are made of a shard."""
    for b in slices(batches, "text", SHARD_BYTES):
        words, first = _words(b.column("text"))
        (at, length, _), _, _ = shard_matches(words, first, tests, window)
        n_hit = np.bincount(np.searchsorted(first, np.flatnonzero(_marks(len(words), at, length)), "right") - 1, minlength=b.num_rows)
        bad = (n_hit > 0) & (20 * n_hit >= np.diff(first))
        yield b.filter(pa.array(~bad)) if bad.any() else b


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents (all their columns, `text` a string) that `contamination` does not mark; clashing column names are safe. A row goes to Python once and
    comes back as it is. A benchmark of more than one block needs the hits of all of them before the verdict."""
    blocks = _blocks(benchmark, BLOCK_BYTES)
    names, texts = next(blocks, ([], []))
    if next(blocks, None) is None:
        tests = documents.sparkSession.sparkContext.broadcast(suffixes_of(names, texts, window))
        return documents.mapInArrow(lambda batches: _clean(tests.value, window, batches), documents.schema)
    row = documents.select(F.col("text").alias("text"), F.struct(*[documents[c] for c in documents.columns]).alias("row"))
    return contamination(row, benchmark, window, keep=("row",)).where("not contaminated").select("row.*")


def op1_decontamination(spark, folder: str) -> DataFrame:
    read = spark.read.parquet
    m = contamination(read(f"{folder}/documents.parquet"), read(f"{folder}/benchmark.parquet"))
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
