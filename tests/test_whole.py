"""Searches that do their whole job: what lies behind the edge of a beam is found too, and what is passed by cannot count."""

import numpy as np
import pyarrow as pa
import pytest

from nearfield import queries
from nearfield.operators import flat, graph, kmeans, pq, quick, shortlist


def behind_a_gate(n=7500):
    """An arc, a group that only its far end links to, and queries at its near end whose nearest rows are that group."""
    rng = np.random.default_rng(4)
    low = np.flatnonzero(np.array([graph.level_of(i, 16) for i in range(n)]) == 0)[:70]
    group, gate = low[:60], low[60:]
    x, t = np.zeros((n, 4)), 3 * rng.permutation(n) / n
    t[gate] = 3
    x[:, 0], x[:, 1] = np.cos(t), np.sin(t)
    x[gate, 2] = 0.3
    x[group] = [0, 0, 10, 0]
    x[group, 3], x[gate, 3] = 0.1 * rng.random(60), 0.01 * rng.random(10)
    t = 0.01 * np.arange(20)
    return x.astype(np.float32), np.stack([np.cos(t), np.sin(t), np.full(20, 0.5), np.ones(20)], axis=1).astype(np.float32)


def table(spark, x, key="vec_id", first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(x)], f"{key} long, embedding array<float>")


def brute(x, q, k=10):
    x, q = x.astype(float), q.astype(float)
    return [np.lexsort((np.arange(len(x)), 1 - (x * v).sum(1)))[:k].tolist() for v in q]


def found_by(spark, monkeypatch, name, x, q):
    rows, asks = table(spark, x), table(spark, q, "qid")
    monkeypatch.setattr(queries, "base", lambda spark, sf_dir: rows)
    monkeypatch.setattr(queries, "asked", lambda rows: asks)
    found = {i: [] for i in range(len(q))}
    for r in queries.queries()[name](spark, "").orderBy("qid", "rank").collect():
        found[r.qid].append(r.vec_id)
    return [found[i] for i in range(len(q))]


def test_f2_hnsw_exhaustive_topk_has_no_beam_that_ends(spark, monkeypatch):
    x, q = behind_a_gate()
    assert found_by(spark, monkeypatch, "hnsw_exhaustive_topk", x, q) == brute(x, q)


def test_f2_a_whole_beam_finds_what_links_lead_to():
    x, q = behind_a_gate()
    g = graph.Graph(x, np.arange(len(x)))
    even = g.ids % 2 == 0
    assert [[i for _, i in r] for r in g.search_all(q, 10, len(g.x))] == brute(x, q)
    some = np.flatnonzero(np.arange(len(x)) % 2 == 0)
    assert [[i for _, i in r] for r in g.search_all(q, 10, len(g.x), even)] == [some[r].tolist() for r in brute(x[some], q)]
    # it is a walk still: rows that nothing links to are not found
    lost = g.layers[0].links
    lost[np.isin(lost, g.node[np.isin(g.ids, brute(x, q)[0])])] = -1
    assert not {i for _, i in g.search_all(q[:1], 10, len(g.x))[0]} & set(brute(x, q)[0])


def test_f3_part_hnsw_exhaustive_topk_has_no_beam_that_ends(spark, monkeypatch):
    # parts are cut by norm: the arc, its gate and the group in one of them, short rows in the others
    x, q = behind_a_gate()
    some = 1e-3 * np.random.default_rng(5).normal(size=(3 * len(x), 4)).astype(np.float32)
    x = np.vstack([x, some])
    assert found_by(spark, monkeypatch, "part_hnsw_exhaustive_topk", x, q) == brute(x, q)


def near_rows(kind, n=1600, d=16):
    rng = np.random.default_rng(7)
    far = rng.normal(size=(n, d))
    if kind == "spread":
        return far.astype(np.float32)
    few = np.repeat(far[: n // 16], 16, axis=0)
    return (few if kind == "copies" else few + 0.05 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("kind", ["near", "copies", "spread"])
def test_f1_groups_that_are_passed_by_lose_nothing(spark, kind, monkeypatch):
    monkeypatch.setattr(quick, "NEAR_BLOCK", 20)
    x = near_rows(kind)
    rows = table(spark, x).repartition(5).sortWithinPartitions("vec_id")
    ids = [*range(0, 1600, 37), 5000, 5001]  # two have no rows near them by number
    q = np.vstack([x[ids[:-2]], 9 * x[:2]])
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, q, strict=True)], "qid long, embedding array<float>")
    found = {i: [] for i in ids}
    for r in quick.search_near(rows, asks, 10, 16).orderBy("qid", "rank").collect():
        found[r.qid].append(r.vec_id)
    assert [found[i] for i in ids] == brute(x, q)


def batch_of(x, **more):
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    return pa.RecordBatch.from_pydict({"vec_id": pa.array(np.arange(len(x))), "v": vectors} | more)


def test_f1_few_pairs_are_measured(monkeypatch):
    x = near_rows("near")
    q, measured = x[::20].astype(float), []
    add = shortlist.Nearest.add_pairs
    monkeypatch.setattr(shortlist.Nearest, "add_pairs", lambda self, which, *a: measured.append(len(which)) or add(self, which, *a))
    bound = np.sort(1 - q @ x.T.astype(float), axis=1)[:, 9] + 1e-9
    (found,) = quick._scan_groups(np.arange(len(q)), q, bound, 10, 16)(iter([batch_of(x)]))
    assert found["vec_id"].to_numpy().reshape(-1, 10).tolist() == brute(x, x[::20]) and sum(measured) < 0.2 * len(q) * len(x)


def test_f1_kernels_in_single_precision_lose_nothing():
    x = near_rows("copies")
    x[3, 0], x[4, 0], x[5, 0] = 1e30, -1e30, 3e38
    q, qid = x[16::20].astype(float), np.arange(79)
    q = q[:79]
    probed = np.random.default_rng(2).random((79, 4)) < 0.5
    lists = pa.array(np.arange(len(x)) % 4)
    parts = [batch_of(x, list_id=lists).slice(a, 300) for a in range(0, len(x), 300)]
    got, want = (pa.Table.from_batches(flat._scan(qid, of(q), 10, None, probed)(iter(parts))) for of in (quick.products(10), flat.metric_kernel("ip")))
    assert got.num_rows == want.num_rows and np.allclose(got["dist"], want["dist"], rtol=1e-12, atol=1e-12)
    x = near_rows("near")
    book = np.random.default_rng(3).normal(size=(4, 16, 4))
    parts = [batch_of(x, list_id=lists).slice(a, 300) for a in range(0, len(x), 300)]
    for p in (1, 40, 2000):
        got, want = (pa.Table.from_batches(shortlist._scan(qid, q, of, p, probed)(iter(parts))) for of in (quick.coded(book, p), pq._adc_kernel(book)))
        assert got.equals(want)


@pytest.mark.parametrize("how", ["ip", "l2"])
def test_f1_centroids_are_those_of_rounded_scores(how):
    rng = np.random.default_rng(9)
    book = rng.normal(size=(40, 4))
    book[7], book[30], book[12] = book[3], book[3] + 1e-14, book[11]
    x = np.vstack([rng.normal(size=(500, 4)), book])
    score = -(x @ book.T) if how == "ip" else (book * book).sum(1)[None] - 2 * x @ book.T
    assert kmeans.assign(x, book, how).tolist() == np.argmin(np.round(score, 12), axis=1).tolist()


def test_f1_ivf_wide_recall_does_not_measure_all_pairs(spark, monkeypatch):
    x = near_rows("spread", 300)
    rows = table(spark, x / np.linalg.norm(x, axis=1)[:, None])
    monkeypatch.setattr(queries, "base", lambda spark, sf_dir: rows)
    monkeypatch.setattr(flat, "search", None)
    monkeypatch.setattr(flat, "metric_kernel", None)
    monkeypatch.setattr(pq, "_adc_kernel", lambda book: None)
    monkeypatch.setattr(pq, "looked_up", None)
    found = queries.ivf_wide_recall(spark, "").collect()
    assert sorted((r.search, r.n_queries) for r in found) == [("ivf", 48), ("ivfpq", 48)]
