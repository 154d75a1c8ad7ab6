"""Kept indexes, stop conditions, the index face, staged streams and plans."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import queries
from nearfield.operators import flat, graph, index, ivf, partition, pq, quant, shard, topk
from nearfield.plans import report
from nearfield.plans.options import SearchOptions
from nearfield.sources import tables
from nearfield.streaming import search as streaming

SCHEMA = "vec_id long, embedding array<float>"
SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def x():
    v = np.random.default_rng(1).normal(size=(300, 16)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def base(spark, x):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def asked(base):
    return base.where("vec_id < 6").select(F.col("vec_id").alias("qid"), "embedding")


def ids(rows):
    return {(r.qid, r.rank): r.vec_id for r in rows.collect()}


def test_graphs_are_kept(spark, base, asked, tmp_path):
    rows = partition.partitioned(base, 3, "contiguous")
    nodes = graph.build_or_load(rows, f"{tmp_path}/g", ef=60)
    exact = ids(flat.search(base, asked))
    assert ids(graph.search_nodes(nodes, asked, 10, 300)) == exact
    again = graph.build_or_load(rows, f"{tmp_path}/g", ef=60)
    assert again.count() == 300 and "Scan" in again._jdf.queryExecution().toString()
    assert graph.load(spark, f"{tmp_path}/g", {"kind": "other"}) is None and graph.load(spark, f"{tmp_path}/none") is None
    some = graph.load(spark, f"{tmp_path}/g", parts=[1])
    assert {r.part for r in some.select("part").distinct().collect()} == {1}
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan
    found = graph.search_nodes(nodes, asked, 10, 300, allowed=base.where("vec_id % 2 = 0"))
    assert ids(found) == ids(flat.search(base.where("vec_id % 2 = 0"), asked))
    counted = graph.counters(nodes, asked, 10, 20).collect()
    assert len(counted) == 6 and all(0 < r.hops < r.seen for r in counted)
    broken = f"{tmp_path}/g/nodes/part=1"
    import shutil

    shutil.rmtree(broken)
    with pytest.raises(ValueError, match="lost or gained"):
        graph.load(spark, f"{tmp_path}/g")


def test_stored_graphs_are_checked(x):
    g = graph.Graph(x[:40].astype(float), np.arange(40), ef=20)
    t = g.table()
    assert graph.Graph.of_table(t).links == g.links
    for column, cells in (("links", [[[0, 0]], *t["links"].to_pylist()[1:]]), ("node", [*range(39), 50]), ("entry", [False] * 40)):
        import pyarrow as pa

        at = t.column_names.index(column)
        with pytest.raises(ValueError):
            graph.Graph.of_table(t.set_column(at, column, pa.array(cells, t.schema.field(column).type)))


def test_stop_conditions_and_moves(x):
    g = graph.Graph(x.astype(float), np.arange(300), ef=100)
    dist = lambda q: 1 - g.x @ q
    for q in x[:5].astype(float):
        near = g.search_until(q, graph.Within(0.6, least=300))
        assert [n for _, n in near] == [int(n) for n in np.argsort(dist(q), kind="stable") if dist(q)[n] <= 0.6]
        assert len(g.search_until(q, graph.Within(2.0, least=10, most=7))) == 7
        docs = np.arange(300) % 20
        found = g.search_until(q, graph.Documents(docs, 3, 20))
        order = np.argsort(dist(q), kind="stable")
        first = list(dict.fromkeys(docs[order].tolist()))
        assert {docs[n] for _, n in found} == set(first[:3])
        assert all(n % 2 for _, n in g.search_until(q, graph.Beam(50), np.arange(300) % 2 == 1))
    rng = np.random.default_rng(3)
    for i in range(0, 300, 3):
        v = rng.normal(size=16)
        g.move(i, v / np.linalg.norm(v))
    g.check()
    hits = 0
    for q in x[1:60:3].astype(float):
        hits += len({n for _, n in g.search(q, 10, 60)} & {int(n) for n in np.argsort(dist(q), kind="stable")[:10]})
    assert hits >= 0.9 * 200


def test_empty_queries_find_nothing(base, asked):
    none = asked.where("false")
    i = ivf.build(base, 4, 2)
    book = pq.train(topk.vector_columns(base), 4, 4, 1)
    for found in (graph.search(base, none), graph.search_lists(i, none), graph.search_two_level(i, none), shard.search(base, none, 3), ivf.search(i, none), ivf.union_search(i, none), pq.search(base, none, book), quant.u8_search(base, none), flat.document_search(base.select("vec_id", F.lit(1).cast("long").alias("doc"), F.col("embedding").alias("v")), flat.asked(none), 2)):
        assert found.count() == 0


def test_indexes_are_kept(spark, base, asked, tmp_path):
    made = ivf.build_or_load(base, f"{tmp_path}/ivf", 6, 2)
    assert ids(ivf.search(made, asked, 10, 6)) == ids(flat.search(base, asked))
    assert np.array_equal(ivf.build_or_load(base, f"{tmp_path}/ivf", 6, 2).centroids, made.centroids)
    r = pq.build_residual(made, 4, 8, 2)
    pq.save_residual(r, f"{tmp_path}/r", {"a": 1})
    assert pq.load_residual(spark, f"{tmp_path}/r", {"a": 2}) is None
    assert ids(pq.residual_search(pq.load_residual(spark, f"{tmp_path}/r", {"a": 1}), asked, 5, 40, 3)) == ids(pq.residual_search(r, asked, 5, 40, 3))
    parts = shard.build_ivfpq(base, 2, 4, 4, 8, 2)
    shard.save(parts, f"{tmp_path}/s", {"a": 1})
    assert ids(shard.search_ivfpq(shard.load(spark, f"{tmp_path}/s", {"a": 1}), asked, 5, 50, 4)) == ids(shard.search_ivfpq(parts, asked, 5, 50, 4))
    assert ids(shard.search_ivfpq(parts, asked, 10, 300, 4)) == ids(flat.search(base, asked))
    assert shard.load(spark, f"{tmp_path}/s", {"a": 2}) is None and len(shard.load(spark, f"{tmp_path}/s", {"a": 1}, [1])) == 1
    sent = report.merge_profile({str(i): pq.ivf_search(s.index, asked, s.book, 5, 50, 4) for i, s in enumerate(parts)})
    assert [r.candidates for r in sent.collect()] == [30, 30]
    report.write_csv(sent, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert tables.index_path("/a", "ivf", nprobe=3, nlist=8) == "/a/ivf/nlist=8/nprobe=3"


def test_scans_join_nothing(base, asked):
    i = ivf.build(base, 4, 2)
    book = pq.train(topk.vector_columns(base), 4, 4, 1)
    for found in (quant.i8_search(base, asked), quant.half_search(base, asked), pq.adc(topk.vector_columns(base), asked, book, 20), ivf.search(i, asked), ivf.union_search(i, asked)):
        assert "NestedLoop" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["flat", "ivf", "ivfpq", "hnsw"])
def test_one_face_for_all_indexes(spark, base, asked, tmp_path, kind):
    options = SearchOptions(k=10, nprobe=4, top_p=300, ef=300)
    made = index.Index(spark, kind, 400, **({"nlist": 4, "steps": 2} if kind.startswith("ivf") else {}))
    made.add(base.where("vec_id < 200"))
    made.add(base.where("vec_id >= 100"))
    assert len(made) == 300 and ids(made.search(asked, options, full=True)) == ids(flat.search(base, asked))
    made.delete(base.where("vec_id % 3 = 0").select("vec_id"))
    live = base.where("vec_id % 3 <> 0")
    assert ids(made.search(asked, options)) == ids(flat.search(live, asked))
    assert ids(made.search(asked, options, allowed=base.where("vec_id < 150").select("vec_id"))) == ids(flat.search(live.where("vec_id < 150"), asked))
    with pytest.raises(ValueError, match="fewer than 10"):
        made.search(asked, options, allowed=base.where("vec_id < 9").select("vec_id"), full=True)
    made.save(f"{tmp_path}/{kind}")
    back = index.Index.load(spark, f"{tmp_path}/{kind}")
    assert ids(back.search(asked, options)) == ids(flat.search(live, asked))
    back.restore(base.where("vec_id % 3 = 0").select("vec_id"))
    assert ids(back.search(asked, options)) == ids(flat.search(base, asked))
    with pytest.raises(ValueError):
        back.resize(10)
    with pytest.raises(ValueError):
        back.add(base.withColumn("vec_id", F.col("vec_id") + 1000))


def test_staged_streams(spark, base, asked, tmp_path):
    asked.repartition(3).write.parquet(f"{tmp_path}/q")
    i, book = ivf.build(base, 4, 2), pq.train(topk.vector_columns(base), 4, 8, 2)
    stream = streaming.answer_staged(streaming.read_queries(spark, f"{tmp_path}/q", files=1), streaming.ivfpq_stages(i, book, 5, 60, 3), f"{tmp_path}/out", f"{tmp_path}/check")
    stream.awaitTermination()
    assert ids(spark.read.parquet(f"{tmp_path}/out/answers")) == ids(pq.ivf_search(i, asked, book, 5, 60, 3))
    assert {r.stage for r in spark.read.parquet(f"{tmp_path}/out/timings").collect()} == {"probe", "candidates", "rerank"}


def test_recall_of_the_registered_settings(spark):
    every = queries.queries()
    b = queries.base(spark, SF)
    truth = flat.search(b, queries.asked(b), SearchOptions(k=queries.K)).cache()
    found = {}
    for name in ("ivf_flat_topk", "ivfpq_topk", "ivffirstpq_topk", "ivfpq_residual_topk", "pq_topk", "shard_ivfpq_topk", "sq8_topk", "hnsw_beam_topk"):
        found[name] = report.quality(every[name](spark, SF), truth, queries.K, name, 1.0).first()["recall"]
    print(found)
    assert min(found.values()) >= 0.9, found


def test_many_lists_lie_in_files(spark, base, asked, tmp_path):
    for nlist in (8, 300):
        index, path = ivf.build(base, nlist, 1), f"{tmp_path}/{nlist}"
        ivf.save(index, path, {"nlist": nlist})
        files = [f for f in Path(path, "lists").rglob("*.parquet")]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert any("list_id=" in str(f) for f in files) == (nlist == 8)
        assert len(files) <= (nlist + parts if nlist == 8 else parts)
        found = ivf.load(spark, path, {"nlist": nlist})
        assert ids(ivf.search(found, asked, 10, 3)) == ids(ivf.search(index, asked, 10, 3))


def test_lists_that_no_query_probes_are_not_read(spark):
    rows = spark.createDataFrame([(i, i % 4) for i in range(20)], "vec_id long, list_id long")
    assert flat.of_lists(rows, np.array([False] * 4)).count() == 0
    assert {r.list_id for r in flat.of_lists(rows, np.array([True, False, False, True])).collect()} == {0, 3}
    assert flat.of_lists(rows, np.array([True] * 4)) is rows


def test_varied_rows_stay_near_their_row(spark, base):
    rows = queries.varied(base.where("vec_id < 20"), 4).collect()
    old = {r.vec_id: np.array(r.embedding) for r in base.where("vec_id < 20").collect()}
    assert sorted(r.vec_id for r in rows) == list(range(80))
    moved = [np.abs(np.array(r.embedding) - old[r.vec_id // 4]).max() for r in rows]
    assert 0.03 < min(moved) and max(moved) <= queries.SPREAD / 2 + 1e-6
    assert len({tuple(r.embedding) for r in rows}) == 80
