"""What a run moves: exchanges, broadcasts and scans of an executed plan, as a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

#: Metrics of a plan node that count bytes, rows and milliseconds, by kind of node.
_KINDS = {
    "Exchange": ("exchange", "shuffleBytesWritten", "shuffleRecordsWritten", "shuffleWriteTime"),
    "BroadcastExchange": ("broadcast", "dataSize", "numOutputRows", "collectTime"),
    "Scan": ("scan", "filesSize", "numOutputRows", "scanTime"),
    "MapInArrow": ("python", "pythonDataReceived", "pythonNumRowsReceived", "pythonTotalTime"),
}
SCHEMA = "step long, kind string, detail string, bytes long, rows long, seconds double, wall double"


def _below(node) -> list:
    """Children of a plan node; stages and adaptive plans are opened."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec", "TableCacheQueryStageExec"):
        return [node.plan()]
    if name.startswith("Reused"):
        return []
    children = node.children()
    return [children.apply(i) for i in range(children.size())]


def _metric(node, name: str) -> int:
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def communication(rows: DataFrame) -> DataFrame:
    """(step, kind, detail, bytes, rows, seconds, wall): runs ``rows`` and tells what each step of its plan sent, from the last step down.

    Exchanges and broadcasts have the bytes and rows that they moved, scans those of the files that they read after
    pruning, Python steps those that came back. ``seconds`` are summed over tasks; ``wall`` is that of the whole run.
    """
    run = rows._jdf.queryExecution()
    began = time.perf_counter()
    run.toRdd().count()
    wall = time.perf_counter() - began
    out: list[tuple] = []
    stack = [run.executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        kind = "Scan" if name.startswith("Scan parquet") else name
        if kind in _KINDS:
            label, size, count, spent = _KINDS[kind]
            scale = 1e9 if spent == "shuffleWriteTime" else 1e3
            out.append((len(out), label, node.simpleString(80)[:200], _metric(node, size), _metric(node, count), _metric(node, spent) / scale, wall))
        stack += _below(node)[::-1]
    return rows.sparkSession.createDataFrame(out, SCHEMA)
