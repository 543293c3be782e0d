"""Stages against brute force, one after the other, on a small table with planted copies, secrets, junk and repeated lines."""

import corpus_pipeline
import duckdb
from docweave.llm import rules, secrets
from test_llm import cut_lines, fits, near_pairs, odd

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    keep = {r[0] for r in con.execute(f"select doc_id from ({rules.SQL}) where keep").fetchall()}
    docs = [(i, t) for i, t in docs if i in keep]
    docs = [(i, t) for (i, _), t in zip(docs, cut_lines(docs), strict=True)]
    team = {i: i for i, _ in docs}

    def root(i):
        while team[i] != i:
            i = team[i]
        return i

    for a, b, _ in near_pairs(docs):
        team[max(root(a), root(b))] = min(root(a), root(b))
    docs = [(i, secrets.redact(t)) for i, t in docs if root(i) == i]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in docs}
    fits(got, docs, 2048)


def test_stages_keep_columns(spark):
    df = odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == odd(spark).columns
        df = spark.createDataFrame(df.collect(), df.schema)
    assert df.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, True), SF).count() == 0
