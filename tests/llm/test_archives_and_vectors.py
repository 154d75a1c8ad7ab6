"""WARC archives, hard negatives and ball k-means against brute force, with odd rows."""

import gzip
import hashlib
import io
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import ball_kmeans, hard_negatives, warc
from nearfield.llm import queries as llm
from nearfield.llm._vectors import integers

PAGES = "page_id long, url string, html string, digest string, bytes long, shard int, key string, refers_to long"
VECTORS = "vec_id long, embedding array<double>, label int, anchor boolean, norm long, x string, chunk int, asks int"


def pages(spark, rows):
    """Pages with further columns under names of helper columns."""
    return spark.createDataFrame([(*r, "d", 1, 2, "k", 3) for r in rows], PAGES)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, True, 1, "x", 2, 3) for i, v, k in rows], VECTORS)


COPY = "<p>copy</p>" * 100
ODD = [
    (5, "http://a/5", COPY), (9, "http://a/9", COPY), (2, None, COPY), (None, "http://a/n", COPY), (9, "http://b/9", COPY), (9, "http://b/9", COPY),
    (1, "http://a/1", None), (3, "http://a b/3\r\nX: y", ""), (4, "", "short"), (6, "http://a/6", "short"), (7, "http://a/7", "é" * 600_000), (8, "http://a/8", "é" * 600_000),
    (None, None, None), (None, "u", "z" * 999), (11, "u", "z" * 999), (None, "v", "q" * 1000), (None, "w", "q" * 1000), (-4, "http://a/-4", COPY), (12, "http://a/12", "WARC/1.1\r\n\r\n" * 200),
]


def expected(rows):
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = len(data) >= 1000 and last is not None and (page is None or page < last)
        out.append((page, url, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_broadcast", [10, 0])
@pytest.mark.parametrize("shard_rows", [3, 1000])
def test_archives_come_back(spark, tmp_path, most_broadcast, shard_rows):
    path = str(tmp_path / "a")
    warc.write(pages(spark, ODD), path, shard_rows=shard_rows, roll_bytes=600, most_broadcast=most_broadcast)
    found = warc.read(spark, path)
    got = found.select("page_id", "url", "payload_bytes", "payload_sha1", "record_type", "refers_to").collect()
    urls = {"http://a b/3\r\nX: y": "http://a%20b/3%0D%0AX:%20y"}
    assert sorted(map(tuple, got), key=repr) == sorted(((p, urls.get(u, u), *rest) for p, u, *rest in expected(ODD)), key=repr)
    assert warc.dangling(found).isEmpty()
    for r in found.where("record_type = 'response'").collect():
        assert hashlib.sha1(r.payload).hexdigest() == r.payload_sha1
    assert found.select("record_id").distinct().count() == len(ODD)
    listed = spark.read.parquet(f"{path}/manifest").collect()
    assert len(listed) > 3 and {r.file for r in listed} == {p.name for p in Path(path).glob("*.warc.gz")} and not (Path(path) / "_temporary").exists()


def test_archives_do_not_depend_on_partitioning(spark, tmp_path):
    rows = ODD + [(100 + i, f"http://c/{i}", f"page {i % 70} " * 90) for i in range(200)]
    contents = []
    for n, order in ((1, rows), (7, rows[::-1])):
        path = tmp_path / str(n)
        warc.write(pages(spark, order).repartition(n), str(path), shard_rows=16, roll_bytes=2000)
        contents.append({p.name: p.read_bytes() for p in path.glob("*.warc.gz")})
    assert contents[0] == contents[1] and len(contents[0]) > 10
    # sorted, and of the given size but for the record that filled it
    seen = []
    for name in sorted(contents[0]):
        for fields, _ in warc.records(io.BytesIO(gzip.decompress(contents[0][name])), name):
            if fields["warc-type"] != "warcinfo":
                seen.append(fields.get("page-id"))
    pages_seen = [-math.inf if p is None else int(p) for p in seen]
    assert pages_seen == sorted(pages_seen)


def test_each_record_is_a_gzip_member_with_true_lengths(spark, tmp_path):
    import zlib

    warc.write(pages(spark, ODD), str(tmp_path / "a"))
    (file,) = (tmp_path / "a").glob("*.warc.gz")
    data, members = file.read_bytes(), 0
    while data:
        d = zlib.decompressobj(31)
        record = d.decompress(data)
        data, members = d.unused_data, members + 1
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    assert members == len(ODD) + 1


def test_faulty_archives_are_errors(spark, tmp_path):
    path = tmp_path / "a"
    warc.write(pages(spark, ODD), str(path), shard_rows=4)
    with pytest.raises(FileExistsError):
        warc.write(pages(spark, ODD), str(path))
    some = sorted(path.glob("*.warc.gz"))
    some[0].write_bytes(some[0].read_bytes()[:-30])
    with pytest.raises(Exception, match="not the"):
        warc.read(spark, str(path)).count()
    (path / "MANIFEST.json").unlink()
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(path))
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"), "x"))
    record = warc.page_record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, None, "d").replace(b"abc", b"abd")
    with pytest.raises(ValueError, match="differs from its block digest"):
        list(warc.records(io.BytesIO(record), "x"))


def test_an_empty_table_gives_an_empty_archive(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).count() == 0
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_lost_moves_are_taken_up_again(spark, tmp_path):
    """A file that a lost attempt has moved already counts; one that is nowhere is an error."""
    row = lambda n: warc._listed([(0, 0, "f", str(tmp_path / "t"), 1, 1, n, "h")])
    (tmp_path / "t").write_bytes(b"abc")
    move = warc._mover(str(tmp_path))
    list(move(iter([row(3)])))
    list(move(iter([row(3)])))
    with pytest.raises(OSError):
        list(move(iter([row(4)])))


def test_integers():
    import pyarrow as pa

    column = pa.array([[0.5, -0.001], None, [1.0, None], [], [float("nan")], [2.0], [float("inf"), 1.0]], pa.list_(pa.float64()))
    rows, found = integers(column, 256, 1 << 20)
    assert rows.tolist() == [0, 3, 5] and [v.tolist() for v in found] == [[128, -1], [], [512]]
    rows, found = integers(column.slice(2), 256, 1 << 20)
    assert rows.tolist() == [1, 3] and [v.tolist() for v in found] == [[], [512]]
    with pytest.raises(ValueError):
        integers(pa.array([[1e9]]), 256, 1 << 20)


def mined(rows, k=5, n=10):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if i not in held or (label, np.array(q, np.int32).tobytes()) < (held[i][0], np.array(held[i][1], np.int32).tobytes()):
            held[i] = (label, q)
    out = []
    for a, (label, q) in held.items():
        if a % 100:
            continue
        score = sorted((-sum(x * y for x, y in zip(q, p, strict=False)), i, m) for i, (m, p) in held.items() if i != a)
        for s, i, m in [x for x in score if x[2] == label][:k]:
            fit = [(t, j) for t, j, m in score if m != label and -30 * s <= -100 * t <= -90 * s][:n]
            out += [(a, i, at, j, -s, -t) for at, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def odd_vectors(seed, n=600, d=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.choice([0.1, 1, 3], size=(n, 1))
    x[n // 2 : n // 2 + n // 3] = x[n // 2]  # a third are copies
    rows = [(i, x[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None], 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 1), (n + 4, x[0].tolist(), None), (None, x[1].tolist(), 1), (n + 5, [], 1), (n + 6, [0.5, 0.5], 2)]
    rows += [rows[7], (100, [1.0] * d, 0), (100, [1.0] * d, 2), (200, x[0].tolist(), 5), (1000, x[3].tolist(), 9)]
    return rows


@pytest.mark.parametrize(("chunk_rows", "bucket"), [(10_000, 2048), (50, 16)])
def test_hard_negatives_equal_brute_force(spark, chunk_rows, bucket):
    rows = odd_vectors(1)
    got = hard_negatives.mine(vectors(spark, rows).repartition(5), F.col("vec_id") % 100 == 0, chunk_rows=chunk_rows, bucket=bucket)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows)
    assert len(mined(rows)) > 50


def test_buckets_are_passed_over():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = (rng.normal(size=(4000, 8)) * np.linspace(100, 1, 4000)[:, None]).astype(np.int32)
    norm = (x.astype(np.int64) ** 2).sum(1)
    order = np.argsort(-norm)
    table = pa.table({"vec_id": np.arange(4000)[order], "label": (np.arange(4000) % 2)[order], "norm": norm[order], "x": pa.array([v.tobytes() for v in x[order]], pa.binary())})
    chunk, seen = hard_negatives.Chunk(table, 64), []
    plain = hard_negatives._products
    try:
        hard_negatives._products = lambda a, b: (seen.append(a.shape[0] * b.shape[0]), plain(a, b))[1]
        hard_negatives._positives(chunk, table.slice(0, 20), 5)
    finally:
        hard_negatives._products = plain
    assert sum(seen) < 0.5 * 20 * 2000


def test_no_hard_negatives_without_anchors_or_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.5], 2)]):
        assert hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def clustered(rows, size=8, rounds=10, dim=5, scale=1024, seed=3):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in held if i is not None)
    cen = [v for _, v in start[:size]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cen))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in held]
        for j in range(len(cen)):
            mine = [v for (_, v), g in zip(held, got, strict=True) if g == j]
            if mine:
                cen[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = [near(v) for _, v in held]
    inertia = [sum(d for d, j in got if j == c) for c in range(len(cen))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cen]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _), (d, j) in zip(held, got, strict=True)), key=repr)


@pytest.mark.parametrize("size", [1, 3, 8, 40])
def test_clusters_equal_brute_force(spark, size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(400, 5)) + 4 * rng.integers(0, 4, size=(400, 1))
    x[100:230] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[3], (3, x[9].tolist()), (None, x[5].tolist()), (500, None), (501, [1.0] * 4), (502, [1.0] * 6), (503, [None] + [1.0] * 4), (504, [float("nan")] * 5), (505, [float("-inf")] * 5), (506, [0.0] * 5)]
    table = vectors(spark, [(i, v, 0) for i, v in rows]).repartition(6)
    found = ball_kmeans.cluster(table, size=size, dim=5)
    got = ball_kmeans.report(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == clustered(rows, size)
    # most members are in stable cores or reach few neighbours
    assert size < 8 or found.compared < 0.7 * found.every


def test_ball_steps_find_the_nearest(subtests=None):
    rng = np.random.default_rng(5)
    for case in range(60):
        k, d = int(rng.integers(1, 12)), int(rng.integers(1, 4))
        x, c = rng.integers(-6, 7, size=(80, d)).astype(np.int32), rng.integers(-6, 7, size=(k, d))
        if case % 3 == 0:
            x, c = x * (1 << 23), c * (1 << 23)
        far = ((x[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
        for own in (np.full(80, -1, np.int32), rng.integers(0, k, 80).astype(np.int32)):
            got, dist, _ = ball_kmeans.assign(x, own, c)
            assert (got == far.argmin(1)).all() and (dist == far.min(1)).all()


def test_few_or_no_vectors_to_cluster(spark):
    assert ball_kmeans.report(ball_kmeans.cluster(vectors(spark, []), dim=5)).count() == 0
    assert ball_kmeans.report(ball_kmeans.cluster(vectors(spark, [(1, [1.0], 0)]), dim=5)).count() == 0
    rows = [(1, [1.0] * 5), (2, [2.0] * 5)]
    got = ball_kmeans.report(ball_kmeans.cluster(vectors(spark, [(i, v, 0) for i, v in rows]), dim=5))
    assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows)


@pytest.mark.parametrize("name", ["op11_warc_writer", "op12_hard_negatives", "op13_ball_kmeans"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    df, want = llm.queries()[name](spark, "/root/testdata/sf0.01"), c.sql(llm.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = [tuple(r[want.columns.index(x)] for x in columns) for r in want.fetchall()]
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(rows, key=repr)
