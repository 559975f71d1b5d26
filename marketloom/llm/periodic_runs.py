"""Periodic runs of words by a dictionary of basic factors: successor occurrences propose periods."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._arrays import byte_class, slices, utf8, word_bounds, word_hashes

POWER = 4  # a run repeats its period at least so often
LEAST = 6  # words of the shortest run
WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)])
JOINED = 1 << 18  # words that are put together at a time for a digest
Rebuild = Callable[[int, int], tuple[int, int] | None]
RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _pair_names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Names 0, 1, ... of the distinct pairs (values below 2**32)."""
    return np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)[1]


def find_runs(words: np.ndarray, offsets: np.ndarray, power: int = POWER, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all maximal runs with length >= max(least, power * period), power >= 3, by row, start and period.

    words: one number per word; offsets: bounds of the rows in it. A run never crosses rows.

    Per level the factors of length l = 1, 2, 4, ... carry names: a factor of length 2l is a pair of names. The successor of a factor
    is its next occurrence, and only successors within 2l count. Positions i, i + 1, ... whose successors lie at one distance d <= l form
    a stretch of progressions that proposes period d for the words from its first position to its last + l + d. Such a proposal is exact at
    both ends: if the next position had a nearer successor d' < d, the overlap of both periods would be at least d + d' words, so (Fine and
    Wilf) both would be multiples of a shorter one, which position i would have had as successor. A period d in (l / 2, l] is found
    at level l, where its run has at least 3d >= l + d words; larger d wait for the next level. So proposals are extended by the ends of the stretch,
    and runs that two levels propose (d <= l / 2) are kept once. Positions whose factor occurs nowhere else in the row leave the dictionary: no longer
    factor from there occurs again. Memory is a few arrays of the length of the words that remain.
    """
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[1:][row]
    names = np.unique(words, return_inverse=True)[1].astype(np.int64)
    alive = np.arange(len(words))  # positions with a name at this level, ascending
    found, l = [], 1
    while len(alive):
        order = np.lexsort((alive, names, row[alive]))  # occurrences of one factor in one row are neighbours, in text order
        a, same = alive[order], np.zeros(len(alive), bool)
        same[:-1] = (names[order][1:] == names[order][:-1]) & (row[a][1:] == row[a][:-1])
        ahead = np.where(same[:-1], a[1:] - a[:-1], 0) if len(a) > 1 else np.zeros(0, np.int64)
        ahead = np.append(ahead, 0)
        repeats = same | np.append(False, same[:-1])
        distance = np.zeros(len(a), np.int64)
        distance[order] = np.where(ahead <= 2 * l, ahead, 0)
        hit = np.flatnonzero((distance > 0) & (distance <= l))  # distances up to 2l are found again, exactly, by the next level
        if len(hit):
            at, d = alive[hit], distance[hit]
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(d) != 0) | (np.diff(row[at]) != 0)]))
            last = np.append(cut[1:], len(hit)) - 1
            start, period = at[cut], d[cut]
            length = at[last] + l + period - start
            long = (length >= power * period) & (length >= least)
            found.append(np.stack([row[start], start - offsets[row[start]], length, period], 1)[long])
        keep = np.zeros(len(alive), bool)
        keep[order] = repeats
        alive, names = alive[keep], names[keep]
        if 2 * l > (np.diff(offsets).max(initial=0)):
            break
        at = np.searchsorted(alive, alive + l)  # the second half starts l words on and must repeat too
        inside = at < len(alive)
        inside[inside] = alive[at[inside]] == alive[inside] + l
        inside &= alive + 2 * l <= end[alive]
        first, second = names[inside], names[at[inside]]
        alive = alive[inside]
        names = _pair_names(first, second).astype(np.int64)
        l *= 2
    out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    out = out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def _joined_digest(data: bytes, starts: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> str:
    """SHA-256 of the picked words joined by one space, a part at a time."""
    sha, first = hashlib.sha256(), True
    for i in range(0, len(picked), JOINED):
        p = picked[i:i + JOINED]
        sha.update((b"" if first else b" ") + b" ".join([data[s:e] for s, e in zip(starts[p].tolist(), ends[p].tolist())]))
        first = False
    return sha.hexdigest()


def _digests(data: bytes, starts: np.ndarray, ends: np.ndarray, picked: np.ndarray, whole: bool, runs: np.ndarray) -> tuple:
    """The values of RUNS for one row. picked: the row's words as positions in starts; runs: (start, length, period) by start and period."""
    best = (None,) * 4
    listed, kept = hashlib.sha256(), picked
    if len(runs):
        exponent = runs[:, 1] // runs[:, 2]
        top = runs[exponent == exponent.max()].tolist()
        s, n, p = max(top, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = s, n, p, 1000 * n // p
        for i in range(0, len(runs), JOINED):
            listed.update("".join(f"{a},{b},{c}\n" for a, b, c in runs[i:i + JOINED].tolist()).encode())
        change = np.zeros(len(picked) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = picked[np.cumsum(change[:-1]) == 0]
    if whole and not len(runs) and len(picked) < JOINED:
        text = b" ".join(data[starts[picked[0]]:ends[picked[-1]]].split()) if len(picked) else b""
        return (0, *best, listed.hexdigest(), hashlib.sha256(text).hexdigest())
    return (len(runs), *best, listed.hexdigest(), _joined_digest(data, starts, ends, kept))


def _scan(batches: Iterator[pa.RecordBatch], rebuild: Rebuild | None, power: int, least: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        data, offsets = utf8(b.column("_text"))
        starts, ends, bounds = word_bounds(data, offsets, WORD)
        hashes = word_hashes(data, starts, ends, fold=False)
        picked = [np.arange(bounds[i], bounds[i + 1]) for i in range(b.num_rows)]
        changed = [False] * b.num_rows
        for i, key in enumerate(b.column(0).to_pylist() if rebuild else []):
            n = len(picked[i])
            if key is not None and (block := rebuild(key, n)):
                at, period = block
                picked[i], changed[i] = bounds[i] + np.concatenate([np.arange(at), at + np.arange(n - at) % period]), True
        ends_of = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
        row, start, length, period = find_runs(hashes[np.concatenate(picked)], ends_of, power, least)
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        runs, raw = np.stack([start, length, period], 1), data.tobytes()
        values = [_digests(raw, starts, ends, picked[i], not changed[i], runs[cut[i]:cut[i + 1]]) for i in range(b.num_rows)]
        kept = [b.column(n) for n in schema.names[:-7]]
        made = [pa.array(list(x), schema[len(kept) + k].type) for k, x in enumerate(zip(*values, strict=True))]
        yield pa.RecordBatch.from_arrays([*[x.cast(schema[i].type) for i, x in enumerate(kept)], *made], schema=schema)


def periodic_runs(rows: DataFrame, ids: list[str], column: str = "text", rebuild: Rebuild | None = None, power: int = POWER, least: int = LEAST) -> DataFrame:
    """The id columns and, per row, n_runs; start, length, period and exponent_milli of the run with the greatest exact length / period (ties:
    smallest start, then period; none: nulls); runs_sha256 over every run's `start,length,period` line; collapsed_sha256 over the text without the
    words that repeat: a word is dropped if a run contains it after that run's first period.

    A run is a stretch of words with smallest period q and length >= max(least, power * q) that no neighbouring word extends. Words are
    maximal stretches without ASCII white space. rebuild(first id, number of words) may give (at, period): the words from `at` on are then replaced
    by the `period` words from there, over and over (None or a null id: words as they stand).

    Null and empty texts have no words and no runs, and collapse to the empty string. Repeated rows come out repeated. Rows keep their ids, null
    ones too; other columns are ignored, whatever their names. One text is one task's work, in memory of some 100 bytes a word.
    64-bit hashes stand for words: two words of a text collide with a probability of about 2**-64.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if power < 3:
        raise ValueError("runs of fewer than three periods need another search")
    cut = rows.select(*ids, F.col(column).cast("string").alias("_text"))
    schema = T.StructType([cut.schema[i] for i in ids] + T._parse_datatype_string(RUNS).fields)
    arrow = to_arrow_schema(schema)
    return cut.mapInArrow(lambda it: _scan(it, rebuild, power, least, arrow), schema)


def contract_rebuild(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p) by which the query rebuilds a document of n words; None: as it stands."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return periodic_runs(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], "text", contract_rebuild)
