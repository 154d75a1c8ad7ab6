"""What searches hold at a time does not grow with queries, beams or rows; answers are those of brute force."""

import tracemalloc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest

from nearfield import queries
from nearfield.operators import biggraph, flat, graph, pq, shortlist, smallworld


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@contextmanager
def within(mb):
    tracemalloc.start()
    try:
        yield
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < mb, f"{peak:.0f} MB"


@pytest.fixture(scope="module")
def x():
    return unit(np.random.default_rng(21).normal(size=(6000, 16)))


@pytest.fixture(scope="module")
def g(x):
    return graph.Graph(x, np.arange(len(x)))


def brute(x, q, k, good=None):
    some = np.arange(len(x)) if good is None else np.flatnonzero(good)
    d = 1 - q @ x[some].T
    return [[int(some[i]) for i in np.lexsort((some, row))[:k]] for row in d]


def numbers(found):
    return [[i for _, i in r] for r in found]


def test_f1_pieces_of_the_queries_are_bounded(spark, x, monkeypatch):
    monkeypatch.setattr(queries, "PIECE_ROWS", 500)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:2000])], "vec_id long, embedding array<float>")
    sizes = [r["count"] for n in (queries._contiguous(base, 1), queries._bundle(base).nodes) for r in n.groupBy("part", "piece").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 700


def test_f10_pieces_of_a_part_are_built_in_tasks_of_their_own(spark, x):
    from pyspark.sql import functions as F

    from nearfield.operators.partition import partitioned

    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:4000])], "vec_id long, embedding array<float>")
    built = graph.build(partitioned(base, 2, "contiguous"), piece_rows=500)
    held = built.select("part", "piece", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(held) == 8 and len({r.task for r in held}) == 8


def test_f2_filters_take_one_walk(x, g, monkeypatch):
    beams, near = [], smallworld.Graph.nodes_near
    monkeypatch.setattr(smallworld.Graph, "nodes_near", lambda self, q, ef, *a, **k: beams.append(ef) or near(self, q, ef, *a, **k))
    for share in (2, 50):
        good = np.arange(len(x)) % share == 1
        assert numbers(g.search_all(x[:40], 10, 600, good[g.ids])) == brute(x, x[:40], 10, good)
    assert set(beams) == {600}


@pytest.mark.parametrize("way", ["plain", "filtered", "range", "flat"])
def test_f4_wide_beams_are_exact_and_not_kept(x, g, way):
    q, even = np.vstack([x[:900], -x[:124]]), np.arange(len(x)) % 2 == 0
    with within(160):
        found = {"plain": lambda: g.search_all(q, 10, 3000), "filtered": lambda: g.search_all(q, 10, 3000, even[g.ids]), "range": lambda: g.range_all(q, 0.3, 3000), "flat": lambda: g.flat_all(q, 10, 3000)}[way]()
    if way == "range":
        assert [set(r) for r in numbers(found)] == [set(np.flatnonzero(r <= 0.3).tolist()) for r in 1 - q @ x.T]
    else:
        assert numbers(found) == brute(x, q, 10, even if way == "filtered" else None)


def test_f3_documents_end_at_the_next_one(x, g):
    docs = np.arange(len(x)) % 10
    with within(160):
        found = g.documents_all(x, docs[g.ids], 4, 3000)
    for v, r in zip(x[::100], found[::100], strict=True):
        order, met = [], set()
        for i in np.argsort(1 - x @ v, kind="stable").tolist():
            order.append(i)
            met.add(int(docs[i]))
            if len(met) > 4:
                break
        assert [i for _, i in r] == order


@pytest.mark.parametrize("way", ["range", "documents"])
def test_f11_rows_found_are_sent_on(spark, x, monkeypatch, way):
    # every query finds nearly all rows
    g, kept = graph.Graph(x[:2000], np.arange(2000)), {}
    table, n, made = g.table(), 100, []
    rows = table.append_column("doc", pa.array(np.where(np.arange(2000) < 1990, 0, np.arange(2000))))
    rows = rows.append_column("kind", pa.array(np.zeros(2000, dtype=int))).append_column("qid", pa.nulls(2000, pa.int64()))
    asks = pa.table({"kind": np.ones(n, dtype=int), "qid": np.arange(n), "embedding": pa.array(list(x[:n]))})
    both = pa.concat_tables([rows, asks], promote_options="default")
    for c in ("part", "piece"):
        both = both.append_column(c, pa.array(np.zeros(both.num_rows, dtype=int)))
    monkeypatch.setattr(graph, "_pieces", lambda nodes, queries, wanted, answer, schema: kept.update(answer=answer) or spark.createDataFrame([], schema))
    none = spark.createDataFrame([], graph.NODES)
    if way == "range":
        graph.range_nodes(none, none, 3.0, 500)
    else:
        graph.document_nodes(none, none, none.select("vec_id", "node").withColumnRenamed("node", "doc"), 3, 500)
    monkeypatch.setattr(graph, "FOUND_ROWS", 5000, raising=False)
    rows_of = smallworld.Graph.rows_of
    monkeypatch.setattr(smallworld.Graph, "rows_of", lambda self, *a: made.append(1) or rows_of(self, *a))
    found = np.zeros(n, dtype=int)
    for b in graph._met(kept["answer"])(iter(both.combine_chunks().to_batches())):
        # no more is held than what is sent now
        assert b.num_rows < 7000 and len(made) < 40
        made.clear()
        found += np.bincount(b["qid"].to_numpy(), minlength=n)
    if way == "range":
        assert (found == 2000).all()
    else:
        want = [np.sort(1 - x[1990:2000] @ v)[3] for v in x[:n]]  # the last of documents 2 to 4 that are kept, and the first of the next
        assert [int((1 - x[:2000] @ v <= w + 1e-12).sum()) for v, w in zip(x[:n], want, strict=True)] == found.tolist()


@pytest.mark.parametrize("entries", [1, 3])
def test_f9_walks_on_level_0_are_not_kept(x, g, entries):
    with within(30):
        found = g.flat_all(x[:1024], 10, 3000, entries)
    assert numbers(found) == brute(x, x[:1024], 10)


def test_f5_a_piece_is_built_and_asked_in_little_memory():
    x = unit(np.random.default_rng(26).normal(size=(6000, 64)))
    table, q = pa.table({"vec_id": np.arange(6000), "embedding": pa.array(list(x))}), x[:1024]
    with within(32):
        nodes = graph._builder(16, 150)((0, 0), table)
    rows = nodes.append_column("kind", pa.array(np.zeros(6000, dtype=int))).append_column("qid", pa.nulls(6000, pa.int64()))
    asks = pa.table({"part": np.zeros(1024, dtype=int), "piece": np.zeros(1024, dtype=int), "kind": np.ones(1024, dtype=int), "qid": np.arange(1024), "embedding": pa.array(list(q))})
    both = pa.concat_tables([rows, asks], promote_options="default").combine_chunks().to_batches()
    with within(26):
        out = pa.Table.from_batches(graph._met(lambda g, t: lambda qid, v: graph._found(qid, g.search_all(v, 10, 2000)))(iter(both)))
    assert out["vec_id"].to_numpy().reshape(1024, 10).tolist() == brute(x, q, 10)


def test_f5_links_are_stored_at_the_first_rows_of_nodes():
    v = unit(np.random.default_rng(27).normal(size=(40, 8)))[np.arange(100) % 40]
    for g in (graph.Graph(v, np.arange(100)[::-1]), graph.Graph(np.zeros((0, 0)), np.zeros(0, dtype=np.int64))):
        t = g.table()
        t.validate(full=True)
        held = {r["node"]: r["links"] for r in t.to_pylist() if r["links"] is not None}
        assert held == {n: [at[n] for at in g.links if n in at] for n in range(len(g.x))} and t["links"].null_count == len(g.ids) - len(g.x)


def test_f3_documents_of_copies_tie_by_id():
    v = unit(np.random.default_rng(22).normal(size=(5, 8)))[np.arange(1000) % 5]
    g = graph.Graph(v, np.arange(1000)[::-1])
    docs = (np.arange(1000) * 7) % 13
    for i, r in zip(range(5), g.documents_all(v[:5], docs[g.ids], 3, 600), strict=True):
        order = sorted(((1 - (v[999 - j] * v[i]).sum(), j) for j in range(1000)), key=lambda p: (round(p[0], 9), p[1]))
        want, met = [], set()
        for _, j in order:
            want.append(j)
            met.add(int(docs[j]))
            if len(met) > 3:
                break
        assert [j for _, j in r] == want


def test_f6_changes_are_bounded(x):
    # every node loses half its links, and half as many rows join
    g = graph.Graph(x[:4000], np.arange(4000))
    with within(170):
        g.remove(np.arange(0, 4000, 2))
        g.add(np.arange(4000, 6000), x[4000:])
    left = np.concatenate([np.arange(1, 4000, 2), np.arange(4000, 6000)])
    assert numbers(g.search_all(x[:40], 10, 1000)) == [left[r].tolist() for r in brute(x[left], x[:40], 10)]


def test_f18_hubs_do_not_widen_all_rows():
    # all nodes link to one
    rng = np.random.default_rng(23)
    around = np.hstack([np.full((5000, 1), 0.8), 0.6 * unit(rng.normal(size=(5000, 63)))])
    hub = np.vstack([around, np.eye(64)[:1]])
    table = pa.table({"node": np.arange(5001), "v": pa.array(list(hub))})
    with within(120):
        linked = biggraph._linker(16)((0, 0), table)
    assert linked.num_rows == 5001


def test_f18_plans_of_steps_do_not_swell(spark, x, monkeypatch):
    # digits of Spark's estimate of a beam's size doubled with each step, and so did the driver's time
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:600])], "vec_id long, embedding array<double>")
    g, digits, kept = biggraph.build(base), [], biggraph.checkpointed
    monkeypatch.setattr(biggraph, "checkpointed", lambda df: digits.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) or kept(df))
    biggraph.search(g, base.where("vec_id < 3").selectExpr("vec_id as qid", "embedding"), 5, 32, width=2, most_steps=7).count()
    assert 7 < max(digits) < 60 * 7


def test_f7_scans_hold_few_distances():
    rng = np.random.default_rng(24)
    v, q = rng.integers(-2, 3, (6000, 8)).astype(float), rng.integers(-2, 3, (4096, 8)).astype(float)
    batch = pa.record_batch({"vec_id": pa.array(np.arange(6000)[::-1]), "v": pa.array(list(v))})
    with within(160):
        out = pa.Table.from_batches(flat._scan(np.arange(4096), flat.metric_kernel("ip")(q), 10)(iter([batch])))
    want = brute(v[::-1], q[::64], 10)
    got = {int(i): [] for i in range(0, 4096, 64)}
    for a, b in zip(out["qid"].to_pylist(), out["vec_id"].to_pylist(), strict=True):
        if a in got:
            got[a].append(b)
    assert list(got.values()) == want


def test_f13_candidates_are_thinned_in_time():
    rng = np.random.default_rng(25)
    v, q = rng.normal(size=(6000, 8)), rng.normal(size=(3495, 8))
    batch = pa.record_batch({"vec_id": pa.array(np.arange(6000)), "v": pa.array(list(v)), "list_id": pa.array(np.arange(6000) % 2)})
    book = pq.start_book(v[:16], 4)
    with within(330):
        out = list(shortlist._scan(np.arange(3495), q, pq._adc_kernel(book), 300, np.ones((3495, 2), dtype=bool))(iter([batch])))
        merged = list(shortlist._merged(300)(iter(out)))
    adc = pq.looked_up(pq.lookup(q[:5], book), pq.encode(v, book))
    assert merged[0]["vec_ids"].to_pylist()[:5] == [np.lexsort((np.arange(6000), r))[:300].tolist() for r in adc]
    assert sum(b.num_rows for b in merged) == 3495


def test_f16_tables_of_a_list_are_made_once(spark, x, monkeypatch):
    from pyspark.sql import functions as F

    from nearfield.operators import ivf

    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:1000])], "vec_id long, embedding array<float>")
    index, made, kept = ivf.build(base, 3, 1), [], {}
    monkeypatch.setattr(pq, "lookup", lambda q, book, how="l2", old=pq.lookup: made.append(len(q)) or old(q, book, how))
    monkeypatch.setattr(pq, "refined", lambda rows, vectors, blocks, kernel_of, *a: kept.setdefault("kernel", kernel_of))
    pq.local_search(index, pq.local_books(index, 4, 8, 1), base.where(F.col("vec_id") < 50).select(F.col("vec_id").alias("qid"), "embedding"))
    kernel, part = kept["kernel"](x[:50]), pa.record_batch({"list_id": pa.array(np.ones(9, dtype=np.int64)), "v": pa.array(list(x[:9]))})
    first = kernel(np.arange(50), part)
    assert (kernel(np.arange(50), part) == first).all() and made == [50]
    assert (kernel(np.arange(20), part) == first[:20]).all() and made == [50, 20]
