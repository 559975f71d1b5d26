"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._arrays import byte_class, mix, ragged, slices, utf8, word_bounds, word_hashes
from ._store import discard, stored

WORD = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
BUCKETS = 1 << 18
CHUNK = 5_000  # words whose subwords are formed at a time
DIM = 8
SIZES = (3, 4, 5, 6, 7, 8)
WINDOW = 2
DECAY = 0.05
SCALE = 32.0  # of the averaged vectors, so that one word in a window can decide with small vectors
SETTLED = 15  # passes before texts choose their windows anew
LEAST = 5  # word occurrences (by document) that a subword needs to be learned
ROWS = 3_000  # labelled rows of each class that are learned from, at most
THRESHOLD = 0.7


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (bytes, A-Z lower-cased, with word ends marked) of each word, and how many each has; the word itself is one more."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    size = ends - starts + 2
    first = np.cumsum(size) - size
    marked = np.full(int(size.sum()), 1, np.uint64)  # 1 marks both ends
    inside = ragged(first + 1, size - 2)
    marked[inside] = low[ragged(starts, size - 2)]
    grams, owner = [mix(word_hashes(data, starts, ends) ^ np.uint64(7))], [np.arange(len(starts))]
    word = np.repeat(np.arange(len(starts)), size)
    for n in SIZES:
        if len(marked) < n:
            continue
        h = np.zeros(len(marked) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(257) + marked[i:len(marked) - n + 1 + i]
        own = np.flatnonzero(word[:len(h)] == word[n - 1:])
        grams.append(mix(h[own] + np.uint64(n << 58)))
        owner.append(word[own])
    owner, grams = np.concatenate(owner), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return (grams[order] % np.uint64(buckets)).astype(np.int32), np.bincount(owner, minlength=len(starts))


def all_subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """`subwords` of many words, part by part."""
    parts = [subwords(data, starts[i:i + CHUNK], ends[i:i + CHUNK], buckets) for i in range(0, len(starts), CHUNK)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def word_means(weight: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean subword weight of each word, part by part."""
    first, out = np.append(0, np.cumsum(count)), np.zeros(len(count))
    for i in range(0, len(count), CHUNK):
        to = min(i + CHUNK, len(count))
        out[i:to] = np.add.reduceat(weight[grams[first[i]:first[to]]], first[i:to] - first[i]) / count[i:to]
    return out


def word_table(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: index of one occurrence of each, which one every occurrence is, and their hashes."""
    hashes, one, which = np.unique(word_hashes(data, starts, ends, fold), return_index=True, return_inverse=True)
    order = np.argsort(one)  # in order of appearance
    place = np.empty(len(one), np.int64)
    place[order] = np.arange(len(one))
    return one[order], place[which.reshape(-1)], hashes[order]


def window_means(z: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of z over every run of `width` words inside a row (a shorter row is one run): means, first words, rows."""
    n = np.diff(first)
    runs = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    start = ragged(first[:-1], runs)
    row = np.repeat(np.arange(len(n)), runs)
    stop = np.minimum(start + width, first[1:][row])
    sums = np.concatenate([[0.0], np.cumsum(z)])
    return (sums[stop] - sums[start]) / np.maximum(stop - start, 1), start, row


def best_windows(means: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Position of each row's highest mean (first of equals); -1 for a row without words."""
    out = np.full(rows, -1)
    order = np.lexsort((-np.arange(len(means)), means, row))
    last = np.flatnonzero(np.append(np.diff(row[order]) != 0, True)) if len(row) else np.zeros(0, np.int64)
    out[row[order[last]]] = order[last]
    return out


@dataclass
class Model:
    """Log-odds of label 1 is `bias` plus the mean over a window's words of `weight` (the class difference of the embeddings), where a word is
    the mean of its subwords; a text has the score of its highest window."""

    weight: np.ndarray
    bias: float
    width: int = WINDOW

    def word_odds(self, data, starts, ends) -> np.ndarray:
        one, which, _ = word_table(data, starts, ends)
        if not len(one):
            return np.zeros(0)
        return word_means(self.weight, *all_subwords(data, starts[one], ends[one], len(self.weight)))[which]

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = utf8(column)
        starts, ends, first = word_bounds(data, offsets, WORD)
        z = self.word_odds(data, starts, ends)
        means, _, row = window_means(z, first, self.width)
        top = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(top, row, means)
        empty = np.diff(first) == 0
        odds = self.bias + np.where(empty, min(0.0, -self.bias) if self.bias > 0 else 0.0, np.where(empty, 0, top))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(texts: list[str], labels: np.ndarray, width: int = WINDOW, epochs: int = 120, dim: int = DIM, buckets: int = BUCKETS, rate: float = 0.05, seed: int = 1) -> Model:
    """Learn subword vectors and the two softmax rows together, by full-batch descent with momentum.

    Each epoch a text stands for its highest window under the model so far (the first: its word that most tells the classes apart), so
    the vectors learn from the words that matter in toxic texts and from the hardest passages of clean ones.
    """
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = word_bounds(data, offsets, WORD)
    if not len(starts) or len(set(labels.tolist())) < 2:
        share = (float(np.mean(labels)) if len(labels) else 0.0)
        odds = np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5))
        return Model(np.zeros(buckets), float(odds), width)
    one, which, _ = word_table(data, starts, ends)
    grams, count = all_subwords(data, starts[one], ends[one], buckets)
    row_of = np.repeat(np.arange(len(texts)), np.diff(first))
    seen = np.unique(which * np.int64(len(texts)) + row_of)
    w, r = seen // len(texts), seen % len(texts)
    pos, neg = np.bincount(w[labels[r] == 1], minlength=len(one)), np.bincount(w[labels[r] == 0], minlength=len(one))
    z = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((neg + 0.5) / ((1 - labels).sum() + 1))
    z *= np.minimum(pos, 10) / 10
    usual = np.bincount(grams, np.repeat(np.minimum(pos + neg, LEAST).astype(np.float32), count), buckets) >= LEAST
    rng = np.random.default_rng(seed)
    E, U, b = rng.normal(0, 0.1, (buckets, dim)) * usual[:, None], rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    speed = [np.zeros_like(x) for x in (E, U, b)]
    begin_gram = np.cumsum(count) - count
    per_class = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    for epoch in range(epochs):
        if epoch == 0 or epoch >= SETTLED and epoch % 3 == 0:
            if epoch:
                z = word_means(SCALE * E @ (U[:, 1] - U[:, 0]), grams, count)
            means, begin, row = window_means(z[which], first, width)
            top = best_windows(means, row, len(texts))
            doc = np.flatnonzero(top >= 0)
        at = begin[top[doc]]
        easy = rng.integers(0, len(begin), len(doc))  # and windows at random from clean texts
        easy = easy[labels[row[easy]] == 0]
        at, of = np.concatenate([at, begin[easy]]), np.concatenate([doc, row[easy]])
        size = np.minimum(first[1:][of] - at, width)
        words, word_of = np.unique(which[ragged(at, size)], return_inverse=True)
        sample = np.repeat(np.arange(len(at)), size)
        g_of, k = grams[ragged(begin_gram[words], count[words])], count[words]
        o_of = np.repeat(np.arange(len(words)), k)
        V = np.column_stack([np.bincount(o_of, E[g_of, d], len(words)) for d in range(dim)]) / k[:, None]
        mean = np.column_stack([np.bincount(sample, V[word_of, d], len(at)) for d in range(dim)]) / size[:, None]
        logits = SCALE * mean @ U + b
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(at)), labels[of]] -= 1
        g = p * per_class[of][:, None]
        gm = SCALE * (g @ U.T) / size[:, None]
        gw = np.column_stack([np.bincount(word_of, gm[sample, d], len(words)) for d in range(dim)]) / k[:, None]
        gE = np.column_stack([np.bincount(g_of, gw[o_of, d], buckets) for d in range(dim)]) * usual[:, None]
        for i, (x, gx) in enumerate(zip((E, U, b), (gE, SCALE * mean.T @ g, g.sum(0)), strict=True)):
            speed[i] = 0.8 * speed[i] + gx / (np.abs(gx).max() + 1e-12)  # the strongest entry sets the scale, so rare subwords move little
            x -= rate * (1.0, 0.2, 0.5)[i] * speed[i] * (1 - epoch / epochs)
        E *= 1 - DECAY
    return Model(SCALE * E @ (U[:, 1] - U[:, 0]), float(b[1] - b[0]), width)


def held_out(column: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 modulo 3; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` learnable texts of each label, the first by hash of their ids; ids labelled both ways or doubly are left out."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    known = known.where(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    parts = [known.where(f"toxic = {k}").orderBy("h", "doc_id").limit(rows) for k in (0, 1)]
    docs = documents.select("doc_id", "text").where("text is not null")
    return docs.join(parts[0].union(parts[1]).select("doc_id", "toxic"), "doc_id")


def choose(sizes, most_bytes: int) -> list:
    """Keys of (key, label, bytes) rows, in their order, whose texts fit: half the bytes are kept for each class, and what one leaves the other takes.
    A text that does not fit is passed over. A class that has rows but gets none is an error."""
    used, rows, taken, later = [0, 0], [0, 0], [[], []], []
    for at, (key, label, size) in enumerate(sizes):
        rows[label] += 1
        if used[label] + size <= most_bytes // 2:
            used[label] += size
            taken[label].append((at, key))
        else:
            later.append((at, key, label, size))
    for at, key, label, size in later:
        if sum(used) + size <= most_bytes:
            used[label] += size
            taken[label].append((at, key))
    for label in (0, 1):
        if rows[label] and not taken[label]:
            raise ValueError(f"no labelled text of class {label} fits into {most_bytes} bytes ({rows[label]} rows)")
    return [key for _, key in sorted(taken[0] + taken[1])]


def fit(documents: DataFrame, labels: DataFrame, rows: int = ROWS, most_bytes: int = 6 << 20) -> Model:
    """Model from a bounded sample: `rows` ids of each class and `most_bytes` of text, a documented bound dealt by `choose`; ids order it, so it is
    the same each time. Rows that repeat an id and its text count once."""
    sample = stored(labelled_sample(documents, labels, rows).select("doc_id", F.xxhash64("doc_id", F.lit(1)).alias("h"), F.xxhash64("text").alias("t"), F.col("toxic").cast("int").alias("toxic"), "text"), "labelled")
    one = sample.groupBy("h", "doc_id", "t").agg(F.first("toxic").alias("toxic"), F.max(F.octet_length("text")).alias("size")).orderBy("h", "doc_id", "t")
    keys = choose((((r.doc_id, r.t), r.toxic, r.size) for r in one.toLocalIterator()), most_bytes)
    place, texts, marks = {k: i for i, k in enumerate(keys)}, [""] * len(keys), np.zeros(len(keys), np.int64)
    wanted = documents.sparkSession.createDataFrame([(int(i), int(t)) for i, t in keys], "doc_id long, t long")
    for r in sample.join(F.broadcast(wanted), ["doc_id", "t"]).dropDuplicates(["doc_id", "t"]).toLocalIterator():
        texts[place[r.doc_id, r.t]], marks[place[r.doc_id, r.t]] = r.text, r.toxic
    discard(sample)
    return train(texts, marks)


def score(documents: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """All columns of `documents` and the score of each whole text (an own column of that name is replaced). Null and empty texts: the bias alone."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = documents.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), pa.array(shared.value.scores(b.column("text")))], schema=arrow)

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model, "score").select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
