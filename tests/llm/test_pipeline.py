"""The pipeline stage by stage against plain forms, and the driver's contract of its names."""

import brute
import corpus_pipeline
import __spark_entry__ as entry
from nearfield.llm import quality_rules
from nearfield.llm.decontaminate import edit_distance

SF = "/root/testdata/sf0.001"


def plain_items(text):
    drop = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text.translate(drop)))


def test_stages(spark):
    docs = corpus_pipeline._read(spark, SF, "documents")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out[name] = docs
        if name != "mixing":
            assert docs.columns == columns

    kept = {r.doc_id for r in quality_rules.judge(corpus_pipeline._read(spark, SF, "documents"), labels).where("kept").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    held = {i: t for i, t in held.items() if i in kept}
    got = {r.doc_id: r.text for r in out["quality_rules"].collect()}
    assert got == held and len(good & set(held)) > 0.9 * len({i for i in good if len(brute.words(brute_text(spark, i))) >= 50})

    held = {i: t for i, (_, n, t) in brute.lines(held.items(), 2, 51).items() if n == 0 or brute.WORD.search(t)}
    assert {r.doc_id: r.text for r in out["line_dedup"].collect()} == held
    assert out["line_dedup"].where("n_chars <> length(text)").count() == 0

    groups = brute.near(list(held.items()), 5, 80)
    held = {i: t for i, t in held.items() if groups[i][1] == i}
    assert {r.doc_id for r in out["minhash_dedup"].collect()} == set(held)

    items = [plain_items(r.text) for r in bench.collect()]
    for i, t in list(held.items()):
        w = plain_items(t)
        for item in items:
            n, most = len(item), len(item) // 5
            if any(edit_distance(item, w[a : a + n], most) <= most for a in range(len(w) - n + 1) if len(set(item) & set(w[a : a + n])) * 2 > len(set(item))):
                del held[i]
                break
    assert {r.doc_id for r in out["decontaminate"].collect()} == set(held)

    mix = {r.doc_id: r for r in out["mixing"].collect()}
    assert {i: r["size"] for i, r in mix.items()} == {i: len(brute.words(t)) for i, t in held.items()}
    assert all(r.taken <= 2 * r["size"] for r in mix.values())
    whole = sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(str, out["mixing"].collect()))


def brute_text(spark, doc_id):
    if not hasattr(brute_text, "texts"):
        brute_text.texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return brute_text.texts[doc_id]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "decontaminate", "mixing"]
    names = set(entry.queries())
    assert {"pipeline"} <= names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_queries_equal_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    for name in ("op2_suffix_dedup", "op3_substring_dedup", "op6_mixing", "op9_line_dedup", "op10_minhash_dedup"):
        df = entry.queries()[name](spark, SF)
        want = duck.sql(entry.oracle_sql()[name])
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
