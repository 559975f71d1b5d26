"""Language identification by segmentation-marginalised unigram models over a fixed public piece vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._arrays import byte_class, mix, slices, utf8, word_bounds, word_hashes
from .toxicity import held_out

WORD = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])  # letters, and every character outside ASCII
ROWS = 1_000  # learnable texts of a language, at most
LANGUAGES = 1_000  # more are an error
KEPT_BYTES = 1 << 25  # of word scores that a worker keeps
ROUNDS = 3  # of expectation maximisation
FLOOR = 1e-7  # probability of a character outside the vocabulary
UNDETERMINED = "und"


def _gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + codes[i:len(codes) - n + 1 + i].astype(np.uint64)
    return mix(h + (np.uint64(n) << np.uint64(59)))


@dataclass
class Vocabulary:
    """Sorted hashes of pieces, and which lengths of pieces there are."""

    hashes: np.ndarray
    lengths: list[int]

    def __len__(self) -> int:
        return len(self.hashes)


@lru_cache
def vocabulary(model_file: str) -> Vocabulary:
    """The usable pieces of a public piece model, of every length: letters only, lower case, a leading mark for a word's start kept."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {p.lower() for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) for p in [m.id_to_piece(i)]}
    pieces = {p for p in pieces if p.lstrip("▁").isalpha() and p.count("▁") <= 1}
    pieces |= {"▁"} | {c for p in pieces for c in p}
    return Vocabulary(np.unique(np.concatenate([_gram_hash(np.array([ord(c) for c in p], np.uint32), len(p)) for p in pieces])), sorted({len(p) for p in pieces}))


@dataclass
class Lattice:
    """All pieces of a list of words: word begins in one code array, and per piece occurrence its end, length and vocabulary place (size: unknown)."""

    first: np.ndarray
    size: np.ndarray
    end: np.ndarray
    length: np.ndarray
    piece: np.ndarray


def lattice(words: list[str], vocab: Vocabulary) -> Lattice:
    marked = ["▁" + w for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    first = np.cumsum(size) - size
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    end, length, piece = [], [], []
    for n in vocab.lengths:
        if len(codes) < n:
            break
        h = _gram_hash(codes, n)
        inside = np.flatnonzero(word[:len(h)] == word[n - 1:])
        at, ok = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at[inside] = np.minimum(np.searchsorted(vocab.hashes, h[inside]), len(vocab) - 1)
        ok[inside] = vocab.hashes[at[inside]] == h[inside]
        if n == 1:
            at, ok = np.where(ok, at, len(vocab)), np.ones(len(h), bool)
        s = np.flatnonzero(ok)
        end.append(s + n - 1)
        length.append(np.full(len(s), n))
        piece.append(at[s])
    end, length, piece = np.concatenate(end), np.concatenate(length), np.concatenate(piece)
    place = end - first[word[end]]  # position in the word: pieces of one step go together, over all words
    order = np.argsort(place, kind="stable")
    return Lattice(first, size, end[order], length[order], piece[order])


def forward(lat: Lattice, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all segmentations, for every prefix of every word and language. p: languages x (vocabulary + 1).

    Returns scaled prefix sums (position + 1 of each word, as the index of its last character) and the log of each word's scale so far.
    """
    n, k = int(lat.size.sum()), len(p)
    alpha = np.zeros((n, k))
    scale = np.zeros((n, k))  # log of what alpha was divided by
    word = np.repeat(np.arange(len(lat.first)), lat.size)
    place = lat.end - lat.first[word[lat.end]]
    cuts = np.searchsorted(place, np.arange(int(lat.size.max()) + 1)) if len(lat.size) else np.zeros(1, np.int64)
    for step in range(len(cuts) - 1):
        e, m, q = (x[cuts[step]:cuts[step + 1]] for x in (lat.end, lat.length, lat.piece))
        before = e - m
        whole = m == step + 1
        reach = np.where(whole[:, None], 1.0, alpha[np.maximum(before, 0)]) * p[:, q].T
        base = np.where(whole[:, None], 0.0, scale[np.maximum(before, 0)])
        last = scale[np.maximum(e - 1, 0)] if step else np.zeros((len(e), k))
        reach *= np.exp(base - last)  # to the scale of the place before
        to, where = np.unique(e, return_inverse=True)
        sums = np.column_stack([np.bincount(where, reach[:, j], len(to)) for j in range(k)])
        top = np.maximum(sums, 1e-300)
        alpha[to] = 1.0
        scale[to] = (scale[to - 1] if step else 0.0) + np.log(top)
    return alpha, scale


def word_scores(lat: Lattice, p: np.ndarray) -> np.ndarray:
    _, scale = forward(lat, p)
    return scale[lat.first + lat.size - 1]


def _posterior(lat: Lattice, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words for one language (forward-backward)."""
    _, scale = forward(lat, p[None, :])
    f = scale[:, 0]
    word = np.repeat(np.arange(len(lat.first)), lat.size)
    place = lat.end - lat.first[word[lat.end]]
    last = lat.first + lat.size - 1
    b = np.full(len(f), -np.inf)
    b[last] = 0.0
    cuts = np.searchsorted(place, np.arange(int(lat.size.max()) + 1))
    lp = np.log(p)
    for step in range(len(cuts) - 2, -1, -1):
        s = slice(cuts[step], cuts[step + 1])
        e, m, q = lat.end[s], lat.length[s], lat.piece[s]
        inner = m <= step
        np.logaddexp.at(b, e[inner] - m[inner], lp[q[inner]] + b[e[inner]])
    before = lat.end - lat.length
    lead = np.where(place + 1 == lat.length, 0.0, f[np.maximum(before, 0)])
    share = np.exp(lead + lp[lat.piece] + b[lat.end] - f[last][word[lat.end]])
    return np.bincount(lat.piece, share * weight[word[lat.end]], len(p))


@dataclass
class Model:
    """Piece probabilities per language (log domain inside), prior shares, and the vocabulary's hashes."""

    langs: list[str]
    p: np.ndarray
    prior: np.ndarray
    vocab: Vocabulary

    def __post_init__(self):
        self.seen: dict[int, int] = {}  # hash of a byte run -> row of `kept`
        self.kept = np.zeros((0, len(self.langs) + 1))  # scores by language, and the number of letter runs

    def _scored(self, runs: list[bytes]) -> np.ndarray:
        """Scores of byte runs by language, and how many letter runs each holds."""
        known = [_letters(r.decode("utf-8", "replace")) for r in runs]
        words = [w for ws in known for w in ws]
        count = np.array([len(ws) for ws in known], np.int64)
        out = np.zeros((len(runs), len(self.langs) + 1))
        out[:, -1] = count
        if words:
            flat = np.concatenate([word_scores(lattice(words[i:i + 20_000], self.vocab), self.p) for i in range(0, len(words), 20_000)])
            owner = np.repeat(np.arange(len(known)), count)
            for j in range(len(self.langs)):
                out[:, j] = np.bincount(owner, flat[:, j], len(known))
        return out

    def scores(self, hashes: np.ndarray, run) -> np.ndarray:
        """Rows of scores for distinct byte runs by hash; run(i) gives the bytes of one that is new. What is kept is bounded in bytes."""
        if self.kept.nbytes > KEPT_BYTES:
            self.seen, self.kept = {}, self.kept[:0]
        place = np.fromiter((self.seen.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        new = np.flatnonzero(place < 0)
        if len(new):
            at = len(self.kept)
            self.kept = np.concatenate([self.kept, self._scored([run(i) for i in new.tolist()])])
            place[new] = np.arange(at, at + len(new))
            self.seen.update(zip(hashes[new].tolist(), range(at, at + len(new)), strict=True))
        return self.kept[place]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = utf8(column)
        starts, ends, first = word_bounds(data, offsets, WORD)
        n = len(offsets) - 1
        total = np.tile(np.log(self.prior), (n, 1)) if self.langs else np.zeros((n, 0))
        lettered = np.zeros(n, bool)
        if len(starts) and self.langs:
            hashes, one, which = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
            per_word = self.scores(hashes, lambda i: bytes(data[starts[one[i]]:ends[one[i]]]))
            row = np.repeat(np.arange(n), np.diff(first))
            total += np.column_stack([np.bincount(row, per_word[which, j], n) for j in range(len(self.langs))])
            lettered = np.bincount(row, per_word[which, -1], n) > 0
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        odds = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        share = odds[np.arange(n), best] / odds.sum(1)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, share, 0.0)


def _letters(run: str) -> list[str]:
    """Lower-case letter runs of a byte run (it may hold other characters outside ASCII)."""
    if run.isalpha():
        return [run.lower()]
    return "".join(c if c.isalpha() else " " for c in run).lower().split()


def train(rows: list[tuple[str, str]], model_file: str, rounds: int = ROUNDS) -> Model:
    """rows: (language, text). Each language starts from even piece probabilities and improves them by expectation maximisation over its words."""
    vocab = vocabulary(model_file)
    counts: dict[str, dict[str, int]] = {}
    texts: dict[str, int] = {}
    for lang, text in rows:
        c = counts.setdefault(lang, {})
        texts[lang] = texts.get(lang, 0) + 1
        for w in "".join(x if x.isalpha() else " " for x in text).lower().split():
            c[w] = c.get(w, 0) + 1
    langs = sorted(counts)
    p = np.zeros((len(langs), len(vocab) + 1))
    for i, lang in enumerate(langs):
        words = list(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        p[i] = 1 / len(vocab)
        p[i, -1] = FLOOR
        for _ in range(rounds if words else 0):
            c = np.zeros(len(vocab) + 1)
            for a in range(0, len(words), 20_000):
                c += _posterior(lattice(words[a:a + 20_000], vocab), p[i], weight[a:a + 20_000])
            c = c[:-1] + 0.1
            p[i, :-1] = c / c.sum()
    total = sum(texts.values())
    return Model(langs, p, np.array([texts[x] / total for x in langs]) if langs else np.zeros(0), vocab)


def fit(documents: DataFrame, model_file: str, rows: int = ROWS, chars: int = 4_000) -> Model:
    """Model from a bounded sample: the first `rows` learnable texts of each language by hash of the id, of each its first `chars` characters."""
    learn = documents.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang", F.substring("text", 1, chars).alias("text")).withColumn("h", F.xxhash64("doc_id"))
    langs = [r[0] for r in learn.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    # ids first: what meets in the one task of a top-n list is then a few bytes a row
    ids = [(r[0],) for lang in langs for r in learn.where(F.col("lang") == lang).select("doc_id", "h").orderBy("h", "doc_id").limit(rows).collect()]
    chosen = F.broadcast(documents.sparkSession.createDataFrame(ids, "doc_id long").distinct())  # `rows` a language at most
    return train([(r[0], r[1]) for r in learn.join(chosen, "doc_id").orderBy("lang", "h", "doc_id").select("lang", "text").toLocalIterator()], model_file)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of `documents` with lang_pred and score (own columns of these names are replaced) of every whole text. No letters: und, 0."""
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = documents.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, share = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), pa.array(lang, pa.string()), pa.array(share, pa.float64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def op7_language_id(spark, folder: str) -> DataFrame:
    from .sentencepiece import public_model

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), fit(docs, public_model())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
