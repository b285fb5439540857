"""Every registered query of the library against SQL over the same tables."""

import glob
import os

import duckdb
import pytest

from watchfold import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    out = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        out.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return out


def plain(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(got, columns, wanted):
    return sorted((tuple(plain(r[columns.index(c)]) for c in wanted) for r in got), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tables, name):
    df, expected = queries.QUERIES[name](spark, SF), tables.sql(queries.SQL[name])
    wanted = sorted(df.columns)
    assert wanted == sorted(expected.columns)
    assert rows(df.collect(), df.columns, wanted) == rows(expected.fetchall(), expected.columns, wanted)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_sequence_sums_at_ties(spark, tmp_path):
    """Two days whose sums weighed by place are ties at the fourth decimal, but for what binary numbers lose."""
    tables = duckdb.connect()
    tables.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/events.parquet' WHERE (user_id, CAST(ts AS DATE)) IN ((14, DATE '2024-01-13'), (134, DATE '2024-01-24'))) TO '{tmp_path}/events.parquet'")
    tables.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df, expected = queries.QUERIES["sequence_sums"](spark, str(tmp_path)), tables.sql(queries.SQL["sequence_sums"])
    wanted = sorted(df.columns)
    got = rows(df.collect(), df.columns, wanted)
    assert got == rows(expected.fetchall(), expected.columns, wanted)
    assert sorted(r[wanted.index("w_session_progress")] for r in got) == [0.0288, 0.3137]


def planted_files(spark, name, monkeypatch):
    """The raw files that a query of planted lines reads."""
    from watchfold import stage_queries

    read = []
    monkeypatch.setattr(stage_queries, "planted", lambda *args, planted=stage_queries.planted: read.append(planted(*args)) or read[-1])
    queries.QUERIES[name](spark, SF)
    return read[0].inputFiles()


def test_raw_rejects_reads_few_files(spark, monkeypatch):
    """A file with a header for each task that writes, not one for each of 1,500 lines."""
    assert 0 < len(planted_files(spark, "raw_rejects", monkeypatch)) <= 32


def test_raw_without_rejects_reads_few_files(spark, monkeypatch):
    assert 0 < len(planted_files(spark, "raw_without_rejects", monkeypatch)) <= 32
