"""Exact merge-type SentencePiece encoding by backtracking, and decoding, without the library's encoder."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._arrays import mix, ragged, slices

SPACE = "▁"
CACHED = 300_000  # segments kept per worker
SLICE = 1 << 20
_MODELS: dict[str, "MergeModel"] = {}


class MergeModel:
    """A merge-type (BPE) piece model with byte fallback, identity normalisation, a dummy prefix and kept white space.

    A pair of pieces merges when their concatenation is a piece; the highest score merges first, ties from the left. `encode_segment`
    finds the same segmentation left to right: it takes the longest piece at a place that is compatible with the piece before
    it (re-merging the two gives the two again), steps back where none is, and marks places that cannot be part of the result.
    """

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = m.bos_id(), m.eos_id(), m.unk_id()
        self.pieces = [m.id_to_piece(i) for i in range(m.vocab_size())]
        special = {i for i in range(m.vocab_size()) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(m.vocab_size()) if m.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.bytes}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.whole: dict[str, bool] = {}
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            self.machine.add_word(p, len(p))
        self.machine.make_automaton()
        chars = sorted({c for p in self.ids for c in p})
        self.alphabet = np.zeros(0x110000, np.uint16)
        self.alphabet[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        width = len(chars) + 1
        self.joins = np.zeros((width, width), bool)  # neighbours that some piece holds; elsewhere no merge can cross
        for p in self.ids:
            a = self.alphabet[[ord(c) for c in p]]
            self.joins[a[:-1], a[1:]] = True
        self.plain = [None if i == self.unk or self.bytes.get(i, 0) > 127 else chr(self.bytes[i]) if i in self.bytes else "" if i in (self.bos, self.eos) else p.replace(SPACE, " ")
                      for i, p in enumerate(self.pieces)]
        self.space = int(self.alphabet[ord(SPACE)])
        self.cache: dict[str, np.ndarray] = {}
        self.runs: dict[int, list[int]] = {}

    def merge(self, text: str) -> list[str]:
        """Segmentation by merging itself: the definition, used on pairs of pieces and runs of spaces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        """Neighbours a, b stay apart: merging their concatenation gives exactly them."""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            if len(self.pair_ok) > 1 << 18:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self.merge(a + b) == [a, b]
        return ok

    def reachable(self, p: str) -> bool:
        ok = self.whole.get(p)
        if ok is None:
            ok = self.whole[p] = self.merge(p) == [p]
        return ok

    def longest(self, text: str) -> list[list[int]]:
        """Ends of the pieces that begin at each place, longest first, from one pass of the automaton."""
        found: list[list[int]] = [[] for _ in text]
        for end, size in self.machine.iter(text):
            found[end - size + 1].append(end + 1)
        for f in found:
            f.reverse()  # the automaton reports them by end, so they grow
        return found

    def encode_segment(self, text: str) -> list[int]:
        if len(text) == 1:
            i = self.ids.get(text)
            return [i] if i is not None else [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unk]
        if text in self.ids and self.reachable(text):
            return [self.ids[text]]
        starts = self.longest(text)
        for i, s in enumerate(starts):
            if not s or s[-1] != i + 1:
                s.append(i + 1)  # a character outside the vocabulary stands alone
        dead = bytearray(len(text) // 8 + 1)  # bit per place: no compatible way on from here
        path: list[tuple[int, int]] = []  # start of a piece, next choice at its end
        at, choice = 0, 0
        while at < len(text):
            ends, took = starts[at], False
            prev = text[path[-1][0]:at] if path else None
            while choice < len(ends):
                to = ends[choice]
                choice += 1
                if to < len(text) and dead[to >> 3] >> (to & 7) & 1:
                    continue
                piece = text[at:to]
                if self.reachable(piece) and (prev is None or self.compatible(prev, piece)):
                    path.append((at, choice))
                    at, choice, took = to, 0, True
                    break
            if not took:
                dead[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise ValueError("no segmentation")
                at, choice = path.pop()
        bounds = [a for a, _ in path] + [len(text)]
        out: list[int] = []
        for a, b in zip(bounds, bounds[1:]):
            i = self.ids.get(text[a:b])
            out += [i] if i is not None else [self.byte_ids[x] for x in text[a:b].encode()] if self.byte_ids else [self.unk]
        return out

    def segment_ids(self, text: str) -> np.ndarray:
        got = self.cache.get(text)
        if got is None:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            if text.strip(SPACE):
                got = self.encode_segment(text)
            else:
                if len(text) > 512:  # blocks of the longest run merge alike from the left
                    return np.array(self.long_run(len(text)), np.uint32)
                got = [self.ids[p] for p in self.merge(text)]
            got = self.cache[text] = np.array(got, np.uint32)
        return got

    def long_run(self, n: int) -> list[int]:
        """A long run of spaces: the merge order is periodic, so its middle repeats the longest piece."""
        pieces = self.merge(SPACE * 256)
        body = pieces[0]
        keep = (n - 256) // len(body)
        return [self.ids[body]] * keep + [self.ids[p] for p in self.merge(SPACE * (n - keep * len(body)))]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, with begin and end ids, and the offsets of the texts."""
        prepared = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(prepared)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in prepared])])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        a = self.alphabet[codes]
        # A run of spaces keeps its last one for the word after it when they can merge; words begin at that space.
        cut = np.ones(len(a), bool)
        if len(a):
            left, right = a[:-1], a[1:]
            run = (left == self.space) & (right == self.space)
            after = np.zeros(len(a), bool)
            after[:-1] = (right != self.space) & self.joins[self.space, right]
            after[offsets[1:][(offsets[1:] > 0)] - 1] = False
            joins = self.joins[left, right]
            cut[1:] = ~joins
            cut[1:][run] = after[1:][run]
            cut[offsets[:-1][offsets[:-1] < len(a)]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(a))
        one, which = distinct_runs(codes, begin, end)
        order = [joined[b:e] for b, e in zip(begin[one].tolist(), end[one].tolist())]
        known = [self.segment_ids(p) for p in order]
        # A lone space that did not merge with its word belongs to the run of spaces before it.
        loose = np.array([len(p) > 1 and p[0] == SPACE and p[1] != SPACE and self.pieces[k[0]] == SPACE for p, k in zip(order, known)], bool)
        fix = np.flatnonzero(loose[which] & (begin > 0)) if len(begin) else np.zeros(0, np.int64)
        fix = fix[(fix > 0)]
        fix = fix[(a[begin[fix] - 1] == self.space) & ~np.isin(begin[fix], offsets)]
        sizes = np.array([len(k) for k in known], np.int64)
        flat = np.concatenate(known) if known else np.zeros(0, np.uint32)
        first = np.cumsum(sizes) - sizes
        extra: dict[int, np.ndarray] = {}
        for i in fix:
            extra[i - 1] = self.segment_ids(joined[begin[i - 1]:end[i - 1]] + SPACE)
            extra[i] = known[which[i]][1:]
        count = sizes[which]
        for i, v in extra.items():
            count[i] = len(v)
        per_text = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(begin, offsets)]
        lengths = np.diff(per_text) + 2
        out_offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(out_offsets[-1], np.uint32)
        body = np.ones(len(out), bool)
        body[out_offsets[:-1]] = body[out_offsets[1:] - 1] = False
        out[out_offsets[:-1]], out[out_offsets[1:] - 1] = self.bos, self.eos
        if extra:
            out[body] = np.concatenate([extra.get(i, known[w]) for i, w in enumerate(which.tolist())])
        else:
            out[body] = flat[ragged(first[which], count)]
        return out, out_offsets

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids vanish, runs of byte ids are UTF-8 (U+FFFD for each byte that is not), the dummy prefix goes."""
        texts = [self.plain[i] for i in ids]
        if None not in texts:  # single-byte characters need no look at their neighbours
            lead = next((i for i in ids if i not in (self.bos, self.eos)), self.bos)
            return "".join(texts)[self.pieces[lead].startswith(SPACE):]
        out, held, first = [], bytearray(), True

        def flush():
            if held:
                out.append(utf8_or_marks(bytes(held)))
                held.clear()

        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                first = False
                continue
            flush()
            if i in (self.bos, self.eos):
                continue
            p = " ⁇ " if i == self.unk else self.pieces[i]
            if first and p.startswith(SPACE):
                p = p[1:]
            first = False
            out.append(p.replace(SPACE, " "))
        flush()
        return "".join(out)


def distinct_runs(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct run of codes, and which of them every run is. Runs are told apart by a 64-bit hash and their length."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    place = np.arange(len(codes)) - np.repeat(begin, end - begin)
    h = mix(h ^ (place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    key = mix(np.add.reduceat(h, begin) + (end - begin).astype(np.uint64))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    return one, which


def utf8_or_marks(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def model(path: str) -> MergeModel:
    """The model of a worker, read once."""
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode(documents: DataFrame, model_file: str) -> DataFrame:
    """Every column of `documents` (clashing names: they win) with `ids` array<int>, the encoding of the whole text with begin and end ids.

    A null or empty text has the begin and end ids alone. Model files are read where the task runs: the path must exist there.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    docs = documents.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in slices(batches, "text", SLICE):
            ids, offsets = m.encode_batch(pc.fill_null(b.column("text"), "").to_pylist())
            column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), column.cast(arrow[-1].type)], schema=arrow)

    return docs.mapInArrow(run, schema)


def digests(documents: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256 and decoded_sha256 of every whole text, in one pass."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    docs = documents.select(*keep, "text")
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in slices(batches, "text", SLICE):
            ids, offsets = m.encode_batch(pc.fill_null(b.column("text"), "").to_pylist())
            raw = ids.astype("<u4").tobytes()
            pairs = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            id_hash = [hashlib.sha256(raw[4 * x:4 * y]).hexdigest() for x, y in pairs]
            text_hash = [hashlib.sha256(m.decode(ids[x:y].tolist()).encode()).hexdigest() for x, y in pairs]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns[:-1], arrow)), pa.array(np.diff(offsets), pa.int64()), pa.array(id_hash), pa.array(text_hash)], schema=arrow)

    return docs.mapInArrow(run, schema)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, folder: str) -> DataFrame:
    return digests(spark.read.parquet(f"{folder}/documents.parquet"), public_model())
