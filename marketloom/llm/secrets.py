"""Secret scans with one combined deterministic automaton over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ._arrays import slices, utf8
from .automaton import Dfa, compile_rules

SLICE = 2 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, longest, non-overlapping matches, of which those with `least` characters (in group `group`) count."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    scan: str = ""  # what the combined pass looks for instead, to keep it small: must occur in every match


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


BASE = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24, scan="[0-9a-f]{9}"),
)
#: Well-known public token formats beside the base rules.
MORE = (
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 40, scan="gh[pousr]_"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 20, scan="xox[abprs]-"),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", 39, scan="AIza"),
    Rule("pay", "[sr]k_live_[A-Za-z0-9]+", 24, scan="[sr]k_live_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, scan="eyJ"),
    Rule("key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", scan="PRIVATE KEY-----"),
)
RULES = BASE + MORE


@lru_cache
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa]]:
    return compile_rules([r.scan or r.pattern for r in rules], search=True), [compile_rules([r.pattern], search=False) for r in rules]


def _long_enough(rule: Rule, found: bytes) -> bool:
    if not rule.group:
        return len(found) >= rule.least
    return len(re.fullmatch(rule.pattern.encode(), found).group(rule.group)) >= rule.least


def spans_of(data: np.ndarray, last: int, rule: Rule, one: Dfa) -> list[tuple[int, int]]:
    """Matches of one rule in one text (bytes) whose combined scan saw its last end at `last`."""
    raw, at, out = data.tobytes(), 0, []
    for start in np.flatnonzero(one.first_bytes()[data[:last + 1]]).tolist():
        if start >= at and (end := one.longest(raw, start)) > 0:
            at = end
            if _long_enough(rule, raw[start:end]):
                out.append((start, end))
    return out


def scan_column(column: pa.Array, rules: tuple[Rule, ...], both: tuple[Dfa, list[Dfa]]) -> list[list[tuple[int, str, int]]]:
    """Per text the spans (start, kind, end) in code points, by start and then in rule order. One pass of the automaton finds the texts and rules."""
    combined, singles = both
    data, offsets = utf8(column)
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(offsets) - 1)]
    states = combined.states_after(data, offsets)
    ends = np.flatnonzero(combined.accepts[states] > 0)
    if not len(ends):
        return out
    masks, row = combined.accepts[states[ends]], np.searchsorted(offsets, ends, "right") - 1
    for r in np.unique(row).tolist():
        mine = row == r if len(ends) < 1000 else slice(np.searchsorted(row, r), np.searchsorted(row, r, "right"))
        text = data[offsets[r]:offsets[r + 1]]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        found = []
        for k, rule in enumerate(rules):
            hit = np.flatnonzero(masks[mine] >> k & 1)
            if len(hit):
                found += [(int(points[a]), k, int(points[b])) for a, b in spans_of(text, int(ends[mine][hit[-1]] - offsets[r]), rule, singles[k])]
        out[r] = [(a, rules[k].kind, b) for a, k, b in sorted(found)]
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of `documents` and secret_spans (kind, start, end in code points) of each whole text.

    Null and empty texts have no spans; an own column secret_spans is replaced. No shuffle.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = documents.drop("secret_spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("secret_spans", SPANS)])
    arrow = to_arrow_schema(schema)
    both = documents.sparkSession.sparkContext.broadcast(automata(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            found = scan_column(b.column("text"), rules, both.value)
            spans = pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in found], arrow[-1].type)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), spans], schema=arrow)

    return docs.mapInArrow(run, schema)


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """Documents with every secret span replaced by a mark (overlapping spans: one); other texts and columns unchanged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(documents.schema)
    both = documents.sparkSession.sparkContext.broadcast(automata(rules))
    text_at = documents.columns.index("text")

    def clean(text: str, spans) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            column = b.column("text")
            found = scan_column(column, rules, both.value)
            if any(found):
                column = pa.array([clean(t, f) if f else t for t, f in zip(column.to_pylist(), found)], pa.string())
            columns = [c.cast(f.type) for c, f in zip(b.columns, arrow)]
            columns[text_at] = column.cast(arrow[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return documents.mapInArrow(run, documents.schema)


def op6_secrets(spark, folder: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
