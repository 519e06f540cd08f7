"""Every query against its SQL on the smallest tables: columns, types and rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from codeframes.plans.queries import ORACLES, QUERIES

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    assert len(got)
    if name not in ORACLES:
        return
    described = {r[0]: TYPES[r[1]] for r in duck.execute("DESCRIBE " + ORACLES[name]).fetchall()}
    assert dict(df.dtypes) == described
    assert rows(got) == rows(duck.execute(ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_works_without_the_optional_package(spark, monkeypatch):
    import sys

    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) <= names
    monkeypatch.setitem(sys.modules, "codeframes.llm.queries", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() > 0


def test_rows_do_not_depend_on_how_the_input_lies(spark, sf_dir):
    from codeframes.operators import frames, merge
    from codeframes.plans import corpora

    takes = corpora.takes(spark, sf_dir)
    want = sorted(map(tuple, merge.cluster(takes).select("video_id", "seq", "cluster_id").collect()))
    signals = corpora.signals(spark, sf_dir).select("video_id", "seq", "phash")
    kept = sorted(map(tuple, frames.collapse_runs(signals, 3).collect()))
    for n in (1, 5):
        assert sorted(map(tuple, merge.cluster(takes.repartition(n)).select("video_id", "seq", "cluster_id").collect())) == want
        assert sorted(map(tuple, frames.collapse_runs(signals.repartition(n), 3).collect())) == kept


def test_stream_urls_reads_whole_pages(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    filler = "<p>some words</p>\n" * 4000
    html = [
        filler + '<script src="https://cdn.y/own.m3u8?k=2">', filler + "{'videoUrl': 'http://h/own.m3u8'}", filler + '{"videoUrl" : "http://h/own2.m3u8"}' + filler,
        None, filler, filler, "https://cdn.y/first.m3u8 " + filler,
    ]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "html": pa.array(html, pa.string())}), tmp_path / "pages.parquet")
    got = {r.page_id: r.stream for r in QUERIES["stream_urls"](spark, str(tmp_path)).collect()}
    assert got == {
        0: "https://cdn.y/own.m3u8?k=2", 1: "http://h/own.m3u8", 2: "http://h/own2.m3u8", 3: "https://cdn.x/v3.m3u8?t=1", 4: "http://h/4.m3u8", 5: None, 6: "https://cdn.y/first.m3u8",
    }


def test_takes_hold_whole_texts(duck):
    """Neither side cuts the prose of a take."""
    assert "left(" not in ORACLES["code_score"]
    longest = duck.execute(ORACLES["gate"].split("SELECT video_id, seq, score")[0] + "SELECT max(length(text)) FROM takes").fetchone()[0]
    assert longest > 500


def test_hashes_round_as_their_sql_on_one_thread(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    # mirrored and flat pictures: frequencies are equal in pairs, and rounding decides on which side of the median they lie
    grey = np.random.default_rng(1).integers(0, 256, (200, 8, 8))
    grey = np.concatenate([(grey + grey.transpose(0, 2, 1)) // 2, (grey + grey[:, ::-1]) // 2, np.arange(0, 256, 5)[:, None, None] * np.ones((1, 8, 8))])
    vectors = (grey.reshape(-1, 64) + 0.5) / 127 - 1
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect(config={"threads": 1})  # on several its sums add in an order that differs from run to run
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    assert rows(QUERIES["image_phash"](spark, str(tmp_path)).toPandas()) == rows(duck.execute(ORACLES["image_phash"]).df())
