"""DuckDB SQL with the rows of the search queries, built from common parts."""

from __future__ import annotations

from .queries import K, KS, M, NLIST, NPROBE, SHARDS, STEPS, TOP_P

DIM = 64
_Q = "q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0)"
_B = "b AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_IP = "1 - list_inner_product(q, v)"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"


def _unit(a: str) -> str:
    return f"list_transform({a}, lambda x: x / (sqrt(list_inner_product({a}, {a})) + 1e-30))"


def _rank(rows: str, k: int | None = K, extra: str = "") -> str:
    limit = f"WHERE rank <= {k}" if k else ""
    return f"SELECT qid, vec_id, {extra}dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM {rows}) {limit}"


def _final(rows: str) -> str:
    return f"SELECT qid, vec_id, round(dist, 6) + 0.0 AS dist, rank FROM ({rows})"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _flat(dist: str = _IP, where: str = "true", base: str = _B, k: int = K) -> str:
    return _with(_Q, base, f"d AS (SELECT qid, vec_id, {dist} AS dist FROM q, b WHERE {where})") + _final(_rank("d", k))


def _lloyd(name: str, rows: str, size: int, steps: int, how: str, order: str) -> list[str]:
    """CTEs {name}0..{name}{steps} (m, c, cen) and {name}a (vec_id, m, x, c) over rows(vec_id, m, x, ...)."""
    score = "-list_inner_product(x, cen)" if how == "ip" else "list_inner_product(cen, cen) - 2 * list_inner_product(x, cen)"
    near = lambda i: f"(SELECT * FROM (SELECT r.*, c, row_number() OVER (PARTITION BY r.vec_id, r.m ORDER BY round({score}, 12), c) AS pick FROM {rows} r JOIN {name}{i} USING (m)) WHERE pick = 1)"
    out = [
        f"{name}n AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY {order}) - 1 AS rn, count(*) OVER (PARTITION BY m) AS n FROM {rows})",
        f"{name}0 AS (SELECT m, c, list_transform(x, lambda y: round(y, 9)) AS cen FROM {name}n, range({size}) t(c) WHERE rn = c * n // {size})",
    ]
    for i in range(steps):
        out += [
            f"{name}u{i} AS (SELECT m, c, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM {near(i)})",
            f"{name}v{i} AS (SELECT m, c, list(y ORDER BY pos) AS cen FROM (SELECT m, c, pos, round(sum(y) / count(*), 9) AS y FROM {name}u{i} GROUP BY ALL) GROUP BY m, c)",
            f"{name}{i + 1} AS (SELECT m, c, coalesce(v.cen, o.cen) AS cen FROM {name}{i} o LEFT JOIN {name}v{i} v USING (m, c))",
        ]
    return [*out, f"{name}a AS (SELECT * FROM {near(steps)})"]


_IVF = [
    "r AS (SELECT vec_id, 0 AS m, v AS x FROM b)",
    *_lloyd("iv", "r", NLIST, STEPS, "ip", "vec_id"),
    f"cen AS (SELECT CAST(c AS BIGINT) AS list_id, cen FROM iv{STEPS})",
    "lists AS (SELECT vec_id, x AS v, CAST(c AS BIGINT) AS list_id FROM iva)",
    f"probes AS (SELECT * FROM (SELECT qid, q, list_id, 1 - list_inner_product(q, cen) AS dist, row_number() OVER (PARTITION BY qid ORDER BY 1 - list_inner_product(q, cen), list_id) AS rank FROM q, cen) WHERE rank <= {NPROBE})",
]
_SUB = DIM // M
_PARTS = f"p AS (SELECT vec_id, m, list_slice(v, m * {_SUB} + 1, m * {_SUB} + {_SUB}) AS x FROM b, range({M}) t(m))"
_PQ = [_PARTS, *_lloyd("k", "p", KS, STEPS, "l2", "vec_id")]
_LUT = f"lut AS (SELECT qid, m, c, {_l2(f'list_slice(q, m * {_SUB} + 1, m * {_SUB} + {_SUB})', 'cen')} AS d FROM q, k{STEPS})"
_ADC = "adc AS (SELECT qid, vec_id, round(sum(d), 12) AS dist FROM ka JOIN lut USING (m, c) GROUP BY qid, vec_id)"


def _reranked(near: str, p: int = TOP_P) -> list[str]:
    return [f"near AS ({_rank(near, p)})", f"d AS (SELECT qid, vec_id, {_IP} AS dist FROM near JOIN q USING (qid) JOIN b USING (vec_id))"]


def _order(mode: str) -> str:
    key = {
        "none": "true", "primary": "list_extract(lists, 1), list_extract(lists, 2)", "signature": "list_slice(list_sort(lists), 1, 8)",
        "packed": "list_extract(lists, 1) * 281474976710656 + list_extract(lists, 2) * 4294967296 + list_extract(lists, 3) * 65536 + list_extract(lists, 4)",
    }[mode]
    return _with(_Q, _B, *_IVF, "per AS (SELECT qid, list(list_id ORDER BY rank) AS lists FROM probes GROUP BY qid)") + f"SELECT qid, row_number() OVER (ORDER BY {key}, qid) AS place FROM per"


def _chunk(order: str) -> str:
    return f"(row_number() OVER (ORDER BY {order}) * 6 - 1) // count(*) OVER ()"


def _contiguous(n: int) -> str:
    return f"CASE WHEN rn < (n % {n}) * (n // {n} + 1) THEN rn // (n // {n} + 1) ELSE n % {n} + (rn - (n % {n}) * (n // {n} + 1)) // greatest(n // {n}, 1) END"


def _fp16(a: str) -> str:
    unit = "pow(2.0, greatest(floor(log2(abs(x))), -14) - 10)"
    return f"list_transform({a}, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {unit}, 0) * {unit} END)"


_LOW = "params AS (SELECT low, high, (high - low) / 255 AS step FROM (SELECT low, CASE WHEN top > low THEN top ELSE low + 1e-6 END AS high FROM (SELECT min(list_min(v)) AS low, max(list_max(v)) AS top FROM b)))"
_U8 = "list_transform({}, lambda x: CAST(greatest(0, least(255, round((x - low) / step))) AS BIGINT))"
_I8 = "list_transform({}, lambda x: greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round_even(x * scale, 0))))"
_NUMBERED = "nb AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS n FROM b)"
_NEG = "list_transform(v, lambda x: -x)"


def _local_first() -> str:
    """Searches by a book for each list (one step)."""
    parts = [
        f"lp AS (SELECT list_id, vec_id, m, list_slice(v, m * {_SUB} + 1, m * {_SUB} + {_SUB}) AS x FROM lists, range({M}) t(m))",
        "ln AS (SELECT *, row_number() OVER (PARTITION BY list_id, m ORDER BY vec_id) - 1 AS seat, count(*) OVER (PARTITION BY list_id, m) AS size FROM lp)",
        f"l0 AS (SELECT list_id, m, c, list_transform(x, lambda y: round(y, 9)) AS cen FROM ln, range({KS}) t(c) WHERE seat = c * size // {KS})",
    ]
    near = lambda i: f"(SELECT * FROM (SELECT lp.*, c, row_number() OVER (PARTITION BY vec_id, m ORDER BY round({_l2('x', 'cen')}, 12), c) AS pick FROM lp JOIN l{i} USING (list_id, m)) WHERE pick = 1)"
    parts += [
        f"lu AS (SELECT list_id, m, c, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM {near(0)})",
        "lv AS (SELECT list_id, m, c, list(y ORDER BY pos) AS cen FROM (SELECT list_id, m, c, pos, round(avg(y), 9) AS y FROM lu GROUP BY ALL) GROUP BY ALL)",
        "l1 AS (SELECT list_id, m, c, coalesce(v.cen, o.cen) AS cen FROM l0 o LEFT JOIN lv v USING (list_id, m, c))",
        f"la AS (SELECT * FROM {near(1)})",
        f"ll AS (SELECT qid, list_id, m, c, {_l2(f'list_slice(q, m * {_SUB} + 1, m * {_SUB} + {_SUB})', 'cen')} AS d FROM probes JOIN l1 USING (list_id))",
        "adc AS (SELECT qid, vec_id, round(sum(d), 12) AS dist FROM la JOIN ll USING (list_id, m, c) GROUP BY qid, vec_id)",
    ]
    return _with(_Q, _B, *_IVF, *parts, *_reranked("adc")) + _final(_rank("d"))


def _residual() -> str:
    parts = [
        f"rp AS (SELECT vec_id, list_id, m, list_slice(list_transform(list_zip(v, cen), lambda t: t[1] - t[2]), m * {_SUB} + 1, m * {_SUB} + {_SUB}) AS x FROM lists JOIN cen USING (list_id), range({M}) t(m))",
        *_lloyd("s", "rp", KS, STEPS, "l2", "list_id, vec_id"),
        f"slut AS (SELECT qid, m, c, list_inner_product(list_slice(q, m * {_SUB} + 1, m * {_SUB} + {_SUB}), cen) AS d FROM q, s{STEPS})",
        "asked AS (SELECT qid, list_id, list_inner_product(q, cen) AS base FROM probes JOIN cen USING (list_id))",
        "adc AS (SELECT qid, vec_id, 1 - (any_value(base) + round(sum(d), 12)) AS dist FROM asked JOIN sa USING (list_id) JOIN slut USING (qid, m, c) GROUP BY qid, vec_id)",
    ]
    return _with(_Q, _B, *_IVF, *parts, *_reranked("adc")) + _final(_rank("d"))


def _ivf(rows: str = "lists") -> str:
    return _with(_Q, _B, *_IVF, f"d AS (SELECT qid, vec_id, {_IP} AS dist FROM probes JOIN lists USING (list_id))") + _final(_rank("d"))


def _shards() -> str:
    """Each shard's own index, searched and merged."""
    one = lambda i: _with(
        _Q, f"b AS (SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {_contiguous(SHARDS)} AS shard FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS n FROM embeddings)) WHERE shard = {i})",
        *_IVF, *_PQ, _LUT, _IVFPQ, *_reranked("adc"),
    ) + _rank("d")
    return "WITH " + ", ".join(f"shard{i} AS ({one(i)})" for i in range(SHARDS)) + _final(_rank("(" + " UNION ALL ".join(f"SELECT qid, vec_id, dist FROM shard{i}" for i in range(SHARDS)) + ")"))


_IVFPQ = "adc AS (SELECT qid, vec_id, round(sum(d), 12) AS dist FROM probes JOIN lists USING (list_id) JOIN ka USING (vec_id) JOIN lut USING (qid, m, c) GROUP BY qid, vec_id)"


def oracle_sql() -> dict[str, str]:
    pq_final = _final(_rank("d"))
    quarter = "(row_number() OVER (ORDER BY vec_id) * 4 - 1) // count(*) OVER ()"
    documents = _with(
        _Q, _B, f"d AS (SELECT qid, vec_id, label AS doc, {_IP} AS dist FROM q, b)",
        "f AS (SELECT qid, doc, min(struct_pack(dist := dist, vec_id := vec_id)) AS first FROM d GROUP BY qid, doc)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM f)",
    ) + "SELECT d.qid, vec_id, d.doc, round(dist, 6) + 0.0 AS dist FROM d LEFT JOIN o ON o.qid = d.qid AND place = 4 WHERE first IS NULL OR dist < first.dist OR (dist = first.dist AND vec_id < first.vec_id)"
    ivfpq = _with(_Q, _B, *_IVF, *_PQ, _LUT, _IVFPQ, *_reranked("adc")) + pq_final
    return {
        "hnsw_saved_topk": _flat(),
        "hnsw_layer0_entry": _flat(),
        "hnsw_updated_topk": _flat(base=f"b AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN {_NEG} ELSE v END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 7 <> 0))"),
        "ivf_hnsw_loaded_topk": _ivf(),
        "two_level_hnsw_loaded_topk": _ivf(),
        "graph_recall": "SELECT search, CAST(10 AS BIGINT) AS k, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS n_queries, true AS recall_ok FROM (VALUES "
        + ", ".join(f"('{x}')" for x in ("whole, beam 128", "whole, beam 256", "whole, beam 512", "halves, beam 256", "filtered, beam 128", "level 0, one entry, beam 256", "level 0, four entries, beam 256", "lists, beam 256", "two levels, beam 256", "links joined, beam 256")) + ") t(search)",
        "ivf_wide_recall": "SELECT search, CAST(64 AS BIGINT) AS n_lists, CAST(8 AS BIGINT) AS nprobe, CAST(10 AS BIGINT) AS k, (SELECT count(*) FROM embeddings, range(16) r(i) WHERE (vec_id * 16 + i) % 100 = 0) AS n_queries, true AS recall_ok, true AS few_rows FROM (VALUES ('ivf'), ('ivfpq')) t(search)",
        "hnsw_filtered_topk": _flat(where="label % 2 = 0"),
        "part_hnsw_pruned_topk": _with(_Q, f"b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, {quarter} AS part FROM embeddings)", f"d AS (SELECT qid, vec_id, {_IP} AS dist FROM q, b WHERE part IN ((qid // 100) % 3, 1))") + pq_final,
        "hnsw_range_eps": _with(_Q, _B, f"d AS (SELECT * FROM (SELECT qid, vec_id, {_IP} AS dist FROM q, b) WHERE dist <= 0.6)") + _final(_rank("d", None)),
        "hnsw_doc_topk": documents,
        "shard_ivfpq_topk": _shards(),
        "ivf_loaded_topk": _ivf(),
        "ivfpq_loaded_topk": ivfpq,
        "ivfpq_residual_loaded_topk": _residual(),
        "flat_ip_topk": _flat(),
        "flat_l2_topk": _flat(_l2("q", "v")),
        "flat_cosine_topk": _flat(f"1 - list_inner_product({_unit('q')}, {_unit('v')})"),
        "flat_filtered_topk": _flat(where="label % 2 = 0"),
        "flat_exclude_self_topk": _flat(where="qid <> vec_id"),
        "flat_dims_rerank": _with(_Q, _B, "s AS (SELECT qid, vec_id, 1 - list_inner_product(list_slice(q, 1, 32), list_slice(v, 1, 32)) AS dist FROM q, b)", *_reranked("s", 40)) + pq_final,
        "flat_local_p": _with(_Q, _B, _NUMBERED, f"d AS (SELECT qid, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY dist, vec_id) AS place FROM (SELECT qid, vec_id, {_IP} AS dist, {_contiguous(8)} AS shard FROM q, nb)) WHERE place <= 4)") + pq_final,
        "range_search_eps": _with(_Q, _B, f"d AS (SELECT * FROM (SELECT qid, vec_id, {_l2('q', 'v')} AS dist FROM q, b) WHERE dist <= 1.2)") + _final(_rank("d", None)),
        "multivector_doc_topk": documents,
        "sq8_params": _with(_B, _LOW) + "SELECT round(low, 9) + 0.0 AS low, round(high, 9) + 0.0 AS high, round(step, 9) + 0.0 AS step FROM params",
        "sq8_topk": _with(
            _Q, _B, _LOW, f"bc AS (SELECT vec_id, {_U8.format('v')} AS code, low, step FROM b, params)", f"qc AS (SELECT qid, {_U8.format('q')} AS qcode FROM q, params)",
            "s AS (SELECT qid, vec_id, -(low * step * list_sum(code) + step * step * list_sum(list_transform(list_zip(code, qcode), lambda t: t[1] * t[2]))) AS dist FROM qc, bc)", *_reranked("s"),
        ) + pq_final,
        "int8_topk": _with(
            _Q, _B, "sc AS (SELECT 127.0 / max(greatest(list_max(v), -list_min(v))) AS scale FROM b)", f"bc AS (SELECT vec_id, {_I8.format('v')} AS code FROM b, sc)", f"qc AS (SELECT qid, {_I8.format('q')} AS qcode FROM q, sc)",
            "d AS (SELECT qid, vec_id, -list_inner_product(code, qcode) AS dist FROM qc, bc)",
        ) + pq_final,
        "fp16_topk": _with(_Q, _B, f"bh AS (SELECT vec_id, {_fp16('v')} AS v FROM b)", f"qh AS (SELECT qid, {_fp16('q')} AS q FROM q)", f"d AS (SELECT qid, vec_id, {_IP} AS dist FROM qh, bh)") + pq_final,
        "kmeans_ip_centroids": _with(_Q, _B, *_IVF) + "SELECT list_id, generate_subscripts(cen, 1) - 1 AS pos, round(unnest(cen), 6) + 0.0 AS x FROM cen",
        "ivf_list_offsets": _with(_Q, _B, *_IVF) + "SELECT list_id, count(vec_id) AS size, CAST(sum(count(vec_id)) OVER (ORDER BY list_id) - count(vec_id) AS BIGINT) AS first FROM cen LEFT JOIN lists USING (list_id) GROUP BY list_id",
        "ivf_probe_lists": _with(_Q, _B, *_IVF) + "SELECT qid, list_id, round(dist, 6) + 0.0 AS dist, rank FROM probes",
        "ivf_flat_topk": _ivf(),
        "ivf_union_topk": _ivf(),
        "ivf_hnsw_topk": _ivf(),
        "two_level_hnsw_topk": _ivf(),
        "ivf_query_order_primary": _order("primary"),
        "ivf_query_order_signature": _order("signature"),
        "ivf_query_order_none": _order("none"),
        "ivf_query_order_packed": _order("packed"),
        "ivffirstpq_loaded_topk": _local_first(),
        "pq_codes": _with(_B, *_PQ) + "SELECT vec_id, CAST(m AS BIGINT) AS m, CAST(c AS BIGINT) AS c FROM ka",
        "pq_adc_topp": _with(_Q, _B, *_PQ, _LUT, _ADC) + _final(_rank("adc", TOP_P)),
        "pq_topk": _with(_Q, _B, *_PQ, _LUT, _ADC, *_reranked("adc")) + pq_final,
        "ivfpq_topk": ivfpq,
        "ivffirstpq_topk": _local_first(),
        "ivfpq_residual_topk": _residual(),
        "shard_flat_merge": _flat(),
        "hnsw_exhaustive_topk": _flat(),
        "part_hnsw_exhaustive_topk": _flat(),
        "shard_balance": _with(
            _Q, _B, *_IVF, f"placed AS (SELECT vec_id, list_id, {_contiguous(4)} AS shard FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS n FROM lists))",
            "held AS (SELECT shard, count(*) AS local_count FROM placed GROUP BY shard)",
            "scanned AS (SELECT shard, count(*) / (SELECT count(*) FROM q) AS avg_scan FROM placed JOIN probes USING (list_id) GROUP BY shard)",
        ) + "SELECT shard, local_count, round(coalesce(avg_scan, 0), 6) + 0.0 AS avg_scan_count, round(max(coalesce(avg_scan, 0)) OVER () / avg(coalesce(avg_scan, 0)) OVER (), 6) AS imbalance FROM held LEFT JOIN scanned USING (shard)",
        "partition_strategies": _with(_B) + " UNION ALL ".join(
            f"SELECT '{s}' AS strategy, vec_id, {part} AS part FROM b"
            for s, part in (("contiguous", _chunk("vec_id")), ("round_robin", "(row_number() OVER (ORDER BY vec_id) - 1) % 6"), ("random", _chunk("md5(CAST(vec_id AS VARCHAR)), vec_id")), ("norm", _chunk("round(list_inner_product(v, v), 12), vec_id")))
        ),
        "recall_at_k": _with(
            _Q, _B, *_IVF, f"found AS ({_rank(f'(SELECT qid, vec_id, {_IP} AS dist FROM probes JOIN lists USING (list_id))')})", f"truth AS ({_rank(f'(SELECT qid, vec_id, {_IP} AS dist FROM q, b)')})",
        ) + f"SELECT CAST({K} AS BIGINT) AS k, count(*) AS n_queries, round(avg(n / {K}), 6) AS recall FROM (SELECT t.qid, count(f.vec_id) AS n FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid)",
        "delete_then_search": _flat(where="vec_id % 7 <> 0"),
        "upsert_then_search": _flat(base=f"b AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN {_NEG} ELSE v END AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"),
        "replace_deleted": _flat(base=f"b AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, {_NEG} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 = 3))"),
    }
