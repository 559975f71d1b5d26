"""Token counts: greedy word-piece lengths from a linear longest-match automaton that never builds pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._arrays import byte_class, slices, utf8, word_bounds
from .toxicity import word_table

WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)])
MARK = "▁"
_AUTOMATA: dict[str, "LongestMatch"] = {}


class LongestMatch:
    """Trie over a vocabulary of word-initial pieces (with a leading mark) and continuation pieces, with failure links.

    When no edge leads on from a node, the pieces that greedy matching would emit for the node's string are already decided: `popped`
    holds how many, `fail` the node of what remains. Each character is consumed once and each failure shortens the open string,
    so a word costs time linear in its length.
    """

    def __init__(self, pieces: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.whole = [False]
        self.fail: list[int] = [-1]
        self.popped = [0]
        self.rest = self._grow("\0")  # root of continuations: nothing of the word is open
        self.whole[self.rest] = False
        for p in pieces:
            node = self._grow(p if p.startswith(MARK) else "\0" + p)
            self.whole[node] = True
        level = [(0, c, v) for c, v in self.edges[0].items()] + [(self.rest, c, v) for c, v in self.edges[self.rest].items()]
        while level:
            for parent, c, v in level:
                if v == self.rest:
                    continue
                if self.whole[v]:
                    self.fail[v], self.popped[v] = self.rest, 1
                    continue
                count, z = self.popped[parent], self.fail[parent]
                while z >= 0 and c not in self.edges[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][c], count
            level = [(v, c, w) for _, _, v in level if v != self.rest for c, w in self.edges[v].items()]

    def _grow(self, path: str) -> int:
        node = 0
        for c in path:
            if c not in self.edges[node]:
                self.edges.append({})
                self.whole.append(False)
                self.fail.append(-1)
                self.popped.append(0)
                self.edges[node][c] = len(self.edges) - 1
            node = self.edges[node][c]
        return node

    def count(self, word: str) -> int:
        """Pieces of a word under greedy longest match from the left; 1 (the unknown piece) where some place has no match."""
        node, n, edges, fail, popped = 0, 0, self.edges, self.fail, self.popped
        for c in MARK + word.replace("\0", "�"):
            while c not in edges[node]:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
            node = edges[node][c]
        while node != self.rest:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


def automaton(model_file: str) -> LongestMatch:
    """The automaton over a public piece model's vocabulary, built once per worker."""
    if model_file not in _AUTOMATA:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        _AUTOMATA[model_file] = LongestMatch([p for p in pieces if MARK not in p[1:]])
    return _AUTOMATA[model_file]


def count_tokens(documents: DataFrame, model_file: str) -> DataFrame:
    """All columns of `documents` with n_words and n_tokens of every whole text (own columns of these names are replaced).

    Words are runs between white space (space and U+0009 to U+000D); a word that the vocabulary cannot cover is one unknown token.
    Null and empty texts have none. No shuffle; distinct words of a slice are walked once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = documents.drop("n_words", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(model_file)
        for b in slices(batches):
            data, offsets = utf8(b.column("text"))
            starts, ends, first = word_bounds(data, offsets, WORD)
            one, which, _ = word_table(data, starts, ends, fold=False)
            raw = data.tobytes()
            sizes = np.array([matcher.count(raw[s:e].decode("utf-8", "replace")) for s, e in zip(starts[one].tolist(), ends[one].tolist())], np.int64)
            sums = np.concatenate([[0], np.cumsum(sizes[which])]) if len(which) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(sums[first]), pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def op3_token_counts(spark, folder: str) -> DataFrame:
    from .sentencepiece import public_model

    return count_tokens(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), public_model()).select("doc_id", "n_words", "n_tokens")
