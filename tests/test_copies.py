"""Graph queries against their SQL on many copies of few vectors: copies tie, and links among them lead nowhere else."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = ["hnsw_doc_topk", "hnsw_range_eps", "ivf_hnsw_topk", "part_hnsw_exhaustive_topk", "two_level_hnsw_topk", "hnsw_exhaustive_topk", "hnsw_saved_topk", "part_hnsw_pruned_topk", "hnsw_filtered_topk"]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    rng = np.random.default_rng(7)
    few, kind = rng.normal(size=(12, 64)), rng.integers(0, 12, 900)
    x = np.vstack([few[kind], rng.normal(size=(100, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)[order := rng.permutation(1000)]
    label = np.concatenate([kind, rng.integers(0, 12, 100)])[order]
    out = tmp_path_factory.mktemp("copies")
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(1000)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}), out / "embeddings.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_copies_tie_as_in_sql(spark, copies, name):
    df = entry.queries()[name](spark, str(copies))
    columns = sorted(df.columns)
    got = set(map(tuple, df.select(*columns).collect()))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{copies}/embeddings.parquet'")
    want = c.sql(entry.oracle_sql()[name])
    want = {tuple(r[want.columns.index(x)] for x in columns) for r in want.fetchall()}
    assert got == want
