"""Ordered query batches, profiles, round trips, callables, chained streams, joined graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import register_metric
from nearfield.operators import biggraph, flat, graph, index, ivf, pq
from nearfield.operators.topk import vector_columns
from nearfield.plans.options import SearchOptions
from nearfield.plans.profile import communication
from nearfield.sources import tables
from nearfield.streaming import search as streaming

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def x():
    v = np.random.default_rng(21).normal(size=(400, 16)).astype(np.float32)
    v[100:150] = v[99]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def base(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def asked(base):
    return base.where("vec_id < 12").select(F.col("vec_id").alias("qid"), "embedding")


def ids(rows):
    return {(r.qid, r.rank): r.vec_id for r in rows.collect()}


def test_ordered_batches_read_fewer_lists(spark, tmp_path):
    """12,000 queries in batches of 1,000, on points of a circle: neighbours probe the same lists."""
    at = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003 * 2 * np.pi
    table = spark.range(0, 12_000, 1, 4).select(F.col("id").alias("vec_id"), F.array(F.cos(at), F.sin(at)).cast("array<float>").alias("embedding"))
    ivf.save(ivf.build(table, 64, 3), f"{tmp_path}/i", {})
    held = ivf.load(spark, f"{tmp_path}/i")
    q = table.select(F.col("vec_id").alias("qid"), "embedding")
    read, found = {}, {}
    for mode in ("none", "packed"):
        rows = ivf.search(held, q, 3, 4, mode, 1000)
        read[mode] = communication(rows).where("kind = 'scan'").agg(F.sum("bytes"), F.sum("rows")).first()
        found[mode] = rows.agg(F.count("*"), F.sum(F.xxhash64("qid", "vec_id", "rank").cast("decimal(20,0)"))).first()
    assert found["none"] == found["packed"] and found["none"][0] == 36_000
    assert read["packed"][0] < 0.5 * read["none"][0] and read["packed"][1] < 0.5 * read["none"][1]
    sizes = {r["name"]: r for r in tables.index_size(spark, f"{tmp_path}/i").collect()}
    assert {"lists", "centroids", "meta"} == set(sizes) and sizes["lists"].bytes == sum(p.stat().st_size for p in (tmp_path / "i/lists").rglob("*.parquet"))
    with pytest.raises(ValueError):
        ivf.query_order(held, q, 4, "other")


def test_a_run_has_a_row_a_step(base, asked):
    found = communication(ivf.search(ivf.build(base, 4, 2), asked)).collect()
    kinds = {r.kind for r in found}
    assert {"exchange", "python"} <= kinds and all(r.bytes > 0 and r.rows > 0 for r in found if r.kind == "exchange")
    assert [r.step for r in found] == list(range(len(found))) and all(0 < r.wall < 300 for r in found)


@pytest.mark.parametrize("kind", ["flat", "ivf", "ivfpq", "hnsw"])
def test_indexes_come_back_as_built(spark, base, asked, tmp_path, monkeypatch, kind):
    options = SearchOptions(k=5, nprobe=2, top_p=40, ef=64)
    made = index.Index(spark, kind, **({"nlist": 4, "steps": 2} if kind.startswith("ivf") else {}))
    made.add(base)
    made.delete(base.where("vec_id = 3").select("vec_id"))
    want = ids(made.search(asked, options))
    made.save(f"{tmp_path}/{kind}")
    for m, name in ((ivf, "build"), (graph, "build"), (pq, "train")):
        monkeypatch.setattr(m, name, None)
    back = index.Index.load(spark, f"{tmp_path}/{kind}")
    assert ids(back.search(asked, options)) == want
    if kind == "hnsw":
        # rows that come and change are linked into the graphs that were loaded; nothing is built
        more = base.where("vec_id between 20 and 25").withColumn("vec_id", F.col("vec_id") + 1000)
        back.add(more.unionByName(base.where("vec_id = 30").withColumn("embedding", F.transform("embedding", lambda v: -v))))
        live = back.rows.where("vec_id <> 3")
        assert len(back) == 406 and ids(back.search(asked, SearchOptions(k=5, ef=500))) == ids(flat.search(live, asked, SearchOptions(k=5)))
        near = {(r.qid, r.vec_id) for r in back.within(asked, 0.5).collect()}
        assert near == {(r.qid, r.vec_id) for r in flat.range_search(live, asked, 0.5, "ip").collect()}
        docs = back.rows.select("vec_id", (F.col("vec_id") % 9).alias("doc"))
        assert {r.doc for r in back.documents(asked.limit(1), docs, 2).collect()} and back.documents(asked, docs, 2).where("vec_id = 3").count() == 0


def test_local_books_come_back(spark, base, asked, tmp_path):
    made = ivf.build(base, 4, 2)
    books = pq.local_books(made, 4, 8, 2)
    pq.save_local(made, books, f"{tmp_path}/l", {"a": 1})
    assert pq.load_local(spark, f"{tmp_path}/l", {"a": 2}) is None
    back, held = pq.load_local(spark, f"{tmp_path}/l", {"a": 1})
    assert ids(pq.local_search(back, held, asked, 5, 40, 3)) == ids(pq.local_search(made, books, asked, 5, 40, 3))
    assert ids(pq.local_search(back, held, asked, 10, 400, 4)) == ids(flat.search(base, asked))


def test_callables_in_kernels(base, asked, x):
    odd = lambda t: t["vec_id"].to_numpy() % 2 == 1
    assert ids(flat.search(base, asked, predicate=odd)) == ids(flat.search(base, asked, where=F.col("vec_id") % 2 == 1))
    nodes = graph.build(base.withColumn("part", F.lit(0).cast("long")))
    assert ids(graph.search_nodes(nodes, asked, 10, 400, predicate=odd)) == ids(flat.search(base, asked, predicate=odd))
    with pytest.raises(Exception, match="answers for"):
        flat.search(base, asked, predicate=lambda t: np.ones(1)).collect()
    register_metric("l1", lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q)), F.lit(0.0), lambda s, v: s + v), lambda q, v: np.abs(q[:, None] - v[None]).sum(2))
    for options in (SearchOptions(k=4, metric="l1"), SearchOptions(k=4, metric="l1", dims=8, rerank=400)):
        got = ids(flat.search(base, asked, options))
        for i in range(12):
            d = np.abs(x.astype(float) - x[i].astype(float)).sum(1)
            assert [got[i, r] for r in range(1, 5)] == np.lexsort((np.arange(400), d))[:4].tolist()


def test_chained_stages_overlap(spark, base, tmp_path):
    asked = base.where("vec_id < 60").select(F.col("vec_id").alias("qid"), "embedding")
    asked.repartition(6).write.parquet(f"{tmp_path}/q")
    made, book = ivf.build(base, 4, 2), pq.train(vector_columns(base), 4, 8, 2)
    made = ivf.IVF(made.centroids, made.lists.cache())
    chain = streaming.ivfpq_chain(spark, f"{tmp_path}/q", made, book, f"{tmp_path}/out", 5, 60, 3)
    times = chain.finish().collect()
    assert ids(chain.answers()) == ids(pq.ivf_search(made, asked, book, 5, 60, 3))
    of = lambda s: sorted((r.batch, r.began, r.ended) for r in times if r.stage == s)
    probe, rerank = of("probe"), of("rerank")
    assert len(probe) == 6 and rerank
    # a later batch probes while an earlier one is reranked
    assert any(p[1] < r[2] and r[1] < p[2] for p in probe for r in rerank) or any(p[1] < r[1] < probe[-1][2] for p in probe for r in rerank)


@pytest.mark.parametrize("piece_rows", [40_000, 120])
def test_one_graph_across_pieces(spark, base, asked, tmp_path, piece_rows):
    made = biggraph.build(base, piece_rows=piece_rows)
    biggraph.save(made, f"{tmp_path}/g", {"p": piece_rows})
    assert biggraph.load(spark, f"{tmp_path}/g", {"p": 1}) is None
    g = biggraph.load(spark, f"{tmp_path}/g", {"p": piece_rows})
    # a beam as wide as the table finds all, copies and ties too
    assert ids(biggraph.search(g, asked, 10, 400)) == ids(flat.search(base, asked))
    found = biggraph.search(g, asked, 10, 32)
    truth = flat.search(base, asked).groupBy("qid").agg(F.max("dist").alias("far"))
    assert found.join(truth, "qid").where("dist <= far + 1e-9").count() >= 0.9 * 120
    assert biggraph.search(g, asked.where("false")).count() == 0
