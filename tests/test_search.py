"""Search operators: golden values, properties, maintenance, sources, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import flat, graph, ivf, maintain, partition, pq, quant, shard, topk
from nearfield.plans.options import SearchOptions
from nearfield.sources import tables
from nearfield.sources.ship import ship
from nearfield.streaming import search as streaming

VECTORS = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def base(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).cache()


@pytest.fixture(scope="module")
def asked(base):
    return base.where("vec_id < 6").select(F.col("vec_id").alias("qid"), "embedding")


def ids(rows):
    return {(r.qid, r.rank): r.vec_id for r in rows.collect()}


@pytest.mark.parametrize(("metric", "want"), [("l2", [0, 1, 2, 2, 2]), ("ip", [-2, -1, 0, 0, 0]), ("cosine", [0, 0.1835, 0.423, 0.423, 0.423])])
@pytest.mark.parametrize("pad", [(0, 0), (3, 2)])
def test_golden_distances(spark, metric, want, pad):
    rows = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]]
    wide = [[0.0] * pad[0] + [float(v) for v in r] + [0.0] * pad[1] for r in rows]
    b = spark.createDataFrame(list(enumerate(wide)), VECTORS)
    q = spark.createDataFrame([(0, wide[4])], "qid long, embedding array<float>")
    found = flat.search(b, q, SearchOptions(k=5, metric=metric)).orderBy("rank").collect()
    assert [r.dist for r in found] == pytest.approx(want, abs=1e-3)


def test_ties_go_to_the_least_id(spark):
    b = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], VECTORS)
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [r.vec_id for r in flat.search(b, q, SearchOptions(k=3)).orderBy("rank").collect()] == [0, 1, 2]


def test_nulls_other_lengths_and_empty_tables(spark, asked):
    b = spark.createDataFrame([(1, None), (None, [1.0] * 16), (3, [0.5] * 16)], VECTORS)
    assert {r.vec_id for r in flat.search(b, asked, SearchOptions(k=5)).collect()} == {3}
    with pytest.raises(Exception, match="1 components, not 16"):
        flat.search(b.union(spark.createDataFrame([(2, [1.0])], VECTORS)), asked).collect()
    assert flat.search(b.where("false"), asked).count() == 0
    assert flat.search(b, asked.where("false")).count() == 0


def test_options_are_checked():
    for bad in ({"k": 0}, {"metric": "x"}, {"rerank": 3}, {"dims": 0}, {"nprobe": 0}):
        with pytest.raises(ValueError):
            SearchOptions(**bad)


def test_schedules_agree_with_exact(base, asked):
    exact = ids(flat.search(base, asked))
    assert ids(shard.search(base, asked, 7)) == exact
    assert ids(flat.search_local(base, asked, 10, 3, 10)) == exact
    index = ivf.build(base, 6, 3)
    assert ids(ivf.search(index, asked, 10, 6)) == exact
    assert ids(ivf.union_search(index, asked, 10, 6)) == exact
    assert ids(ivf.union_search(index, asked, 10, 2)) == ids(ivf.search(index, asked, 10, 2))
    book = pq.train(topk.vector_columns(base), 4, 8, 3)
    assert ids(pq.search(base, asked, book, 10, 300)) == exact
    assert ids(pq.ivf_search(index, asked, book, 10, 300, 6)) == exact
    assert ids(quant.u8_search(base, asked, 10, 300)) == exact


def test_graphs(base, asked):
    exact = ids(flat.search(base, asked))
    assert ids(graph.search(base, asked, 10, ef=300)) == exact
    for strategy in ("contiguous", "round_robin", "random", "norm"):
        assert ids(graph.search(base, asked, 10, ef=300, parts=3, strategy=strategy)) == exact
    found = ids(graph.search(base, asked, 10, ef=40, mode="flat", entries=4))
    assert len(set(found.items()) & set(exact.items())) >= 0.9 * len(exact)
    rows = base.orderBy("vec_id").toPandas()
    g = graph.Graph(np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy())
    low, high = g.degrees()
    assert low >= 1 and high < 300
    even = np.arange(300) % 2 == 0
    assert all(i % 2 == 0 for _, i in g.search(g.x[7], 10, 50, even))


def test_partitions_are_balanced(base):
    for strategy in ("contiguous", "round_robin", "random", "norm"):
        sizes = [r["count"] for r in partition.partitioned(base, 7, strategy).groupBy("part").count().collect()]
        assert sum(sizes) == 300 and max(sizes) - min(sizes) <= 1
    assert partition.owners({0: 5, 1: 3, 2: 3}, 2) == {0: 0, 1: 1, 2: 1}


def test_documents_and_range(spark, base, asked):
    rows = base.select("vec_id", (F.col("vec_id") % 20).alias("doc"), F.col("embedding").alias("v"))
    got = flat.document_search(rows, flat.asked(asked), 3).groupBy("qid").agg(F.countDistinct("doc").alias("n")).collect()
    assert [r.n for r in got] == [3] * 6
    near = flat.range_search(base, asked, 0.8, "l2").collect()
    assert all(r.dist <= 0.8 for r in near) and {(r.qid, r.vec_id) for r in near} >= {(i, i) for i in range(6)}


def test_maintenance(spark, base, asked):
    none = base.where("false").select("vec_id")
    gone = maintain.mark_deleted(none, base, base.where("vec_id < 3").select("vec_id"))
    found = ids(flat.search(maintain.live(base, gone), asked))
    assert not {0, 1, 2} & set(found.values())
    with pytest.raises(ValueError):
        maintain.mark_deleted(gone, base, base.where("vec_id = 1").select("vec_id"))
    with pytest.raises(ValueError):
        maintain.unmark_deleted(gone, base.where("vec_id = 9").select("vec_id"))
    assert maintain.unmark_deleted(gone, gone).count() == 0
    new = base.where("vec_id in (7, 8)").withColumn("vec_id", F.col("vec_id") + 1000)
    table, left = maintain.replace_deleted(base, gone, new)
    assert table.count() == 300 and [r.vec_id for r in left.collect()] == [2]
    with pytest.raises(ValueError):
        maintain.insert(base, new, 301)
    assert maintain.append(base, new).agg(F.max("vec_id")).first()[0] == 301
    with pytest.raises(Exception, match="no vector 9999"):
        maintain.vectors(base, spark.createDataFrame([(9999,)], "vec_id long")).collect()
    with pytest.raises(ValueError):
        maintain.resized(5, 4)


def test_index_files(spark, base, asked, tmp_path):
    meta = {"nlist": 4, "data": tables.fingerprint(base)}
    made = []

    def build():
        made.append(1)
        index = ivf.build(base, 4, 2)
        return {"centroids": index.table(), "lists": index.lists}

    for _ in range(2):
        got = tables.build_or_load(spark, str(tmp_path / "i"), meta, build)
        assert got["lists"].count() == 300 and got["centroids"].count() == 4
    assert len(made) == 1
    assert tables.load_index(spark, str(tmp_path / "i"), {"nlist": 5}) is None


def test_binary_sources(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    whole = tmp_path / "a.fbin"
    whole.write_bytes(np.array([3, 4], np.uint32).tobytes() + x.tobytes())
    rows = tables.read_bin(spark, str(whole)).orderBy("vec_id").collect()
    assert [r.embedding for r in rows] == x.tolist()
    assert tuple(tables.read_header(spark, str(whole)).select("n", "d").first()) == (3, 4)
    whole.write_bytes(whole.read_bytes()[:-4])
    with pytest.raises(Exception, match="do not hold"):
        tables.read_bin(spark, str(whole)).collect()
    vecs = tmp_path / "a.fvecs"
    vecs.write_bytes(b"".join(np.array([4], np.int32).tobytes() + r.tobytes() for r in x))
    assert [r.embedding for r in tables.read_vecs(spark, str(vecs)).orderBy("vec_id").collect()] == x.tolist()


def test_stream_answers_equal_batch(spark, base, asked, tmp_path):
    asked.repartition(3).write.parquet(str(tmp_path / "q"))
    stream = streaming.read_queries(spark, str(tmp_path / "q"), files=1)
    streaming.answer(stream, lambda q: flat.search(base, q), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == ids(flat.search(base, asked))


def test_reports(base, asked):
    from nearfield.plans.report import Timings, partition_balance, scanned_rows

    assert sum(r.rows for r in partition_balance(base.repartition(3)).collect()) == 300
    index = ivf.build(base, 4, 1)
    got = scanned_rows(ivf.probes(index, asked, 4), index.sizes()).collect()
    assert {r.scanned for r in got} == {300}
    t = Timings()
    with t.step("a"):
        pass
    assert [n for n, _ in t.rows()] == ["a"]
