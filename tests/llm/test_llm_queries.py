"""Registered queries against SQL, and the pipeline against its stages done by hand."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from watchfold.llm import linededup, minhash, mixing, packing, queries

SF = "/root/testdata/sf0.001"


def tables():
    out = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return out


def rows(frame, columns):
    return sorted(str([None if x != x else x.item() if hasattr(x, "item") else x for x in r]) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)  # not by toPandas, which turns integers with nulls into doubles
    expected = tables().sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    n = queries.QUERIES[name](spark, SF).count()
    assert n >= docs if name.split("_")[0] in ("op1", "op7", "op8", "op9", "op10") else n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, SF)
    assert one.columns == docs.columns and one.count() <= docs.count()
    two = stages["line_dedup"](spark, one, SF)
    from test_llm_operators import brute_components, brute_lines

    kept = {d: t for d, t in brute_lines([(r["doc_id"], r["text"]) for r in one.collect()], linededup.MIN_WORDS).items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == kept
    three = stages["near_dedup"](spark, two, SF)
    assert three.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in two.collect()]
    component, sizes = brute_components(texts, minhash.WIDTH)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(d for d, c in component.items() if d == c or not sizes[d])
    four = stages["mixing"](spark, three, SF)
    assert four.columns == docs.columns
    mixed = four.toPandas()
    database = duckdb.connect()
    database.register("docs", three.toPandas())
    copies = dict(database.sql(f"WITH {mixing.REPORT_SQL} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    assert mixed.doc_id.value_counts().to_dict() == copies
    encode = packing.ids_of("byte_bpe_50k.json", "byte_bpe_50k.tiktoken").tokenizer
    lengths = {r.doc_id: len(encode.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.itertuples()}
    for final in (stages["packing"](spark, four, SF).toPandas(), corpus_pipeline.run(spark, SF).toPandas()):
        assert final.groupby("doc_id").length.sum().to_dict() == {d: lengths[d] * n for d, n in copies.items()}
        for _, own in final.groupby("sequence_id"):
            own = own.sort_values("offset")
            assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 2048
        assert final.sequence_id.nunique() <= packing.lower_bound(np.bincount(final.length, minlength=2049)) + 1
