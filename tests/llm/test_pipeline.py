"""Every stage of the pipeline against its plain form, each on what the stage before it kept, and the registered queries against SQL."""

import brute
import corpus_pipeline
import duckdb
import pytest
import sentencepiece
from conftest import FOLDER
from marketloom.llm import queries, secrets, sentencepiece as pieces, toxicity
from test_queries import rows as table_rows

TABLES = [*("documents embeddings pages benchmark labels".split()), "conversations"]


def test_stages_are_dealt_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokenize"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    planted = [(10**6 + k, f"of the {k} and in it is token={'abc123' * k} to a é by on {'f0' * 12} was", "en", "s", 0) for k in range(1, 4)]  # the smallest tables keep no secret this far
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    source = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    import pyarrow as pa

    score = dict(zip(source, model.scores(pa.array(list(source.values()), pa.large_string()))))
    want = {d: t for d, t in source.items() if score[d] < toxicity.THRESHOLD or not (t or "").strip()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if name == "near_duplicates":
            comp = brute.near_duplicates(list(want.items()))
            want = {d: t for d, t in want.items() if comp[d][1] == d}
        elif name == "decontamination":
            bad = brute.contamination(list(want.items()), bench)
            want = {d: t for d, t in want.items() if not bad[d][4]}
        elif name == "secrets":
            assert any(brute.secrets(t, secrets.RULES) for t in want.values())
        if name != "tokenize":
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert set(got) == set(want), name
            if name == "secrets":
                for d, t in want.items():
                    assert bool(brute.secrets(t, secrets.RULES)) == (got[d][0] != t) and not brute.secrets(got[d][0], secrets.BASE) and got[d][1] == len(got[d][0])
                want = {d: got[d][0] for d in want}
            else:
                assert {d: t for d, (t, _) in got.items()} == want
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
            assert {r.doc_id: list(r["ids"]) for r in out.collect()} == {d: lib.encode(t, add_bos=True, add_eos=True) for d, t in want.items()}


def test_stages_take_odd_rows(spark):
    odd = [(None, "a b c d e f", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 1), (4, "token=abcdefgh", None, "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as ids", "2 as toxicity", "3 as n_words", "4 as component_id", "5 as row", "6 as secret_spans")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == len(odd) and (name == "tokenize" or out.columns == docs.columns), name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cols, got = table_rows(queries.QUERIES[name](spark, FOLDER).toPandas())
    wcols, want = table_rows(con.execute(queries.SQL[name]).fetchdf())
    assert cols == wcols and got == want


def test_every_dealt_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
