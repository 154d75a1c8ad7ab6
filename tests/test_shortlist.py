"""Candidates by a cheap kernel, then exact distances: thinning, merging over batches, blocks, against brute force."""

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.operators import flat, ivf, pq, shortlist, topk

VECTORS = "vec_id long, embedding array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], VECTORS)


def found(rows):
    return {(r.qid, r.rank): (r.vec_id, r.dist) for r in rows.collect()}


@pytest.fixture
def clones():
    """Rows with many copies, so that distances tie throughout."""
    x = np.random.default_rng(3).normal(size=(240, 8))
    x[60:180] = x[:6].repeat(20, axis=0)
    return x


@pytest.mark.parametrize("pairs", [8, 1 << 20])
@pytest.mark.parametrize("n", [7, 70_000])
def test_nearest_keeps_the_least(monkeypatch, pairs, n):
    monkeypatch.setattr(shortlist, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    best, seen = shortlist.Nearest(n, 4), []
    for a in range(0, 300, 30):
        which, ids = np.sort(rng.choice(7, 5, replace=False)), np.arange(a, a + 30)[::-1]
        dist = rng.integers(0, 6, (5, 30)).astype(float)
        dist[rng.random(dist.shape) < 0.1] = np.inf
        dist[rng.random(dist.shape) < 0.1] = np.nan
        best.add(which, dist, ids)
        seen += [(int(q), float(d), int(i)) for q, row in zip(which, dist, strict=True) for d, i in zip(row, ids, strict=True) if np.isfinite(d)]
    want = [t for q in range(7) for t in sorted(s for s in seen if s[0] == q)[:4]]
    assert [(int(q), float(d), int(i)) for q, d, i in zip(*best.thin(), strict=True)] == want
    assert best.packed(np.arange(n))["vec_ids"].flatten().to_pylist() == [t[2] for t in want]


def test_a_query_may_span_batches():
    rows = [(q, [10 * p + j for j in range(3)], [float((7 * p + j) % 5) for j in range(3)]) for q in (2, 5, 9) for p in range(4)]
    kind = pa.schema([("qid", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows[a : a + 5]], kind) for a in (0, 5, 10)]
    got = {q: list(zip(d, i, strict=True)) for b in shortlist._merged(5)(iter([*batches, batches[0].slice(0, 0)])) for q, i, d in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {q: sorted((d, i) for r in rows if r[0] == q for d, i in zip(r[2], r[1], strict=True))[:5] for q in (2, 5, 9)}
    assert list(shortlist._merged(5)(iter([]))) == []


@pytest.mark.parametrize("size", [3, 4096])
def test_two_stages_against_brute_force(spark, clones, monkeypatch, size):
    monkeypatch.setattr(shortlist, "block_size", lambda p: size)
    monkeypatch.setattr(pq, "block_size", lambda p: size)
    base = frame(spark, clones).repartition(5)
    asked = base.where("vec_id % 24 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    book = pq.train(topk.vector_columns(base), 4, 8, 2)
    adc = pq.looked_up(pq.lookup(clones[::24], book), pq.encode(clones, book))
    near, exact = {}, {}
    for row, q in enumerate(range(0, 240, 24)):
        few = sorted((adc[row, i], i) for i in range(240))[:20]
        near |= {(q, r + 1): (i, d) for r, (d, i) in enumerate(few)}
        # sum() of floats is compensated, and so is no sum in order
        true = sorted((1 - reduce(add, (float(a) * float(b) for a, b in zip(clones[q], clones[i], strict=True)), 0.0), i) for _, i in few)[:10]
        exact |= {(q, r + 1): (i, d) for r, (d, i) in enumerate(true)}
    assert found(pq.adc(topk.vector_columns(base), asked, book, 20)) == near
    # bit for bit: sums run in the order of the components, so copies tie and ids decide
    assert found(pq.search(base, asked, book, 10, 20)) == exact


def test_same_rows_as_ranking_and_joining(spark, clones):
    base = frame(spark, clones)
    asked = base.where("vec_id % 40 = 1").select(F.col("vec_id").alias("qid"), "embedding")
    index, book = ivf.build(base, 6, 2), pq.train(topk.vector_columns(base), 4, 8, 2)
    r = pq.build_residual(index, 4, 8, 2)
    near = topk.ranked(flat.scan(index.lists, flat.asked(asked), pq._adc_kernel(book), 30, probed_of=ivf.probed_of(index, 3)), 30)
    joined = flat.rerank(near, index.lists.select("vec_id", "v"), flat.asked(asked), 7)
    assert found(pq.ivf_search(index, asked, book, 7, 30, 3)) == found(joined)
    assert found(pq.ivf_search(index, asked, book, 7, 30, 3, pq.coded(index.lists, book, "list_id"))) == found(joined)
    # fewer rows in the probed lists than are asked for
    assert len(found(pq.residual_search(r, asked, 240, 240, 1))) == len(found(ivf.search(index, asked, 240, 1))) < 240 * 6
    # candidates by codes alone have the shape of reranked ones
    assert pq.residual_search(r, asked, 5, 5, 3).columns == pq.residual_search(r, asked, 5, 9, 3).columns == ["qid", "vec_id", "dist", "rank"]


def test_repeated_and_null_rows_and_empty_tables(spark, clones):
    base = frame(spark, clones[:20])
    asked = base.where("vec_id < 2").select(F.col("vec_id").alias("qid"), "embedding")
    book = pq.train(topk.vector_columns(base), 4, 4, 1)
    odd = base.unionByName(spark.createDataFrame([(None, [1.0] * 8), (99, None)], VECTORS)).withColumn("dist", F.lit("x")).withColumn("rank", F.lit("y"))
    assert found(pq.search(odd, asked, book, 5, 20)) == found(pq.search(base, asked, book, 5, 20))
    assert found(pq.search(base.where("false"), asked, book)) == {}
    assert found(pq.search(base, asked.where("false"), book)) == found(pq.adc(topk.vector_columns(base), asked.where("false"), book, 5)) == {}
    twice = found(pq.search(base.unionByName(base), asked, book, 3, 40))
    assert {v[0] for v in twice.values()} <= set(range(20)) and len(twice) == 6
    with pytest.raises(Exception, match="components"):
        pq.search(base.unionByName(spark.createDataFrame([(50, [1.0, 2.0])], VECTORS)), asked, book).collect()


def test_blocks_hold_their_candidates():
    assert shortlist.block_size(10) == flat.QUERY_BLOCK
    assert shortlist.block_size(1 << 12) == 1 << 8
    assert shortlist.block_size(1 << 30) == 1
