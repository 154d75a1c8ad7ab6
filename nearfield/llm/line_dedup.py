"""Repeated runs of lines by winnowing, with DataFrame functions alone.

Of each window of ``window`` lines the line of least hash is selected, the leftmost
of equals, so equal windows select equal lines. Only selected lines are posted, and
any run that is repeated for a window's length or more is sure to have a posted line
in both places. Postings are joined by the line's hash; those that meet another are
extended to the left and to the right, to the windows that selected them, and the
places of equal windows are compared: all but the earliest are repeats. Consecutive
windows of a repeated run overlap, so together they reach to both of its ends, and
the later run's lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import checkpointed, unused

#: A key that holds more than one in HOT of all rows is dealt out to all partitions; there are fewer than HOT such keys.
HOT = 500
_BLANK = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _postings(documents: DataFrame, window: int, long_words: int | None) -> DataFrame:
    """(doc_id, row, pos, fp, windows) of each selected line: its hash and the windows that selected it.

    ``row`` is a hash of the text, for rows that repeat a doc_id. A window is
    (start, lines, key); a line of ``long_words`` words is a window by itself.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), _lines(F.col("text")).alias("lines"))
    # a line without a word is selected only where all lines of a window are such, and those are not posted
    word = r"[^\x20\x09-\x0D]"
    hashed = docs.select(
        "doc_id",
        "row",
        F.transform("lines", lambda x: F.when(x.rlike(word), F.xxhash64(x)).otherwise(F.lit(_BLANK))).alias("h"),
        F.transform("lines", lambda x: F.xxhash64(x, F.lit(9))).alias("g"),
        F.transform("lines", lambda x: x.rlike(_longer(long_words))).alias("long") if long_words else F.lit(None).alias("long"),
    )
    if not long_words:
        hashed = hashed.where(F.size("h") >= window)
    last = F.size("h") - window

    def selected(s: Column) -> Column:
        part = F.slice("h", s + 1, window)
        return F.struct(s.alias("start"), (s + F.array_position(part, F.array_min(part)).cast("int") - 1).alias("at"), F.xxhash64(F.slice("g", s + 1, window)).alias("key"))

    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), selected)).otherwise(F.array().cast("array<struct<start:int,at:int,key:bigint>>"))
    chosen = hashed.withColumn("w", windows)

    def posting(p: Column) -> Column:
        mine = F.filter(F.slice("w", F.greatest(p - (window - 1), F.lit(0)) + 1, window), lambda x: x["at"] == p)
        mine = F.transform(mine, lambda x: F.struct(x["start"].alias("start"), F.lit(window).alias("lines"), x["key"].alias("key")))
        if long_words:
            alone = F.array(F.struct(p.alias("start"), F.lit(1).alias("lines"), F.xxhash64(F.get("g", p), F.lit(1)).alias("key")))
            mine = F.when(F.get("long", p), F.concat(mine, alone)).otherwise(mine)
        return F.struct(p.alias("pos"), F.get("h", p).alias("fp"), mine.alias("windows"))

    every = F.transform(F.sequence(F.lit(0), F.size("h") - 1), posting)
    return chosen.select("doc_id", "row", F.inline(every)).where((F.size("windows") > 0) & (F.col("fp") != _BLANK))


def _longer(words: int) -> str:
    """Matches lines of ``words`` words or more."""
    return r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (words - 1)


def _met(rows: DataFrame, shared: DataFrame, key: str) -> DataFrame:
    """Rows joined with the checkpointed ``shared`` by ``key``; the rows of hot keys are dealt out over all partitions.

    ``shared`` has one row a key, and ``n``, the number of rows that have it.
    """
    total = shared.agg(F.sum("n")).first()[0] or 0
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col("n") > F.lit(max(total // HOT, 1))
    hot = F.broadcast(shared.where(is_hot).select(F.col(key).alias("_hot")))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns[:3]), F.lit(parts)).cast("int"))).drop("_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(shared.withColumn("_salt", F.explode(salts)).drop("n"), [key, "_salt"]).drop("_salt")


def repeated_runs(documents: DataFrame, window: int = 2, long_words: int | None = None) -> DataFrame:
    """(doc_id, row, start, lines) of each window that also starts earlier, if a line of it has a word.

    Earlier: in a document of smaller doc_id, or at a lesser line of the same one.
    """
    posted = _postings(documents, window, long_words)
    shared = checkpointed(posted.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = _met(posted, shared, "fp").select("doc_id", "row", F.inline("windows"))
    met = checkpointed(met.select("doc_id", "row", "start", "lines", F.xxhash64("key", "lines").alias("run")))
    place = F.struct("doc_id", "start")
    first = checkpointed(met.groupBy("run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return _met(met, first, "run").where(place > F.col("first")).select("doc_id", "row", "start", "lines")


def dedup_lines(documents: DataFrame, window: int = 2, long_words: int | None = None) -> DataFrame:
    """Every row with its columns, ``text`` without later repeated runs, and n_lines and n_removed.

    Lines are what lies between newlines, blank ones included; runs are judged on
    the input. A run is ``window`` lines or more, of which one has a word; with
    ``long_words`` a single line of that many words or more is a run by itself,
    whatever its neighbours are. Null text stays null and has one (empty) line. Rows whose doc_id is
    null lose nothing and are no one's earlier copy; rows that repeat a doc_id are
    one document in line order, of which equal lines at one line number are one
    place, so a row that comes twice loses the same lines in both. Columns named n_lines or
    n_removed are replaced. No rows in, no rows out.
    """
    doc, row, runs, kept = unused(documents, "doc", "row", "runs", "kept")
    gone = repeated_runs(documents, window, long_words).groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.collect_set(F.struct("start", "lines")).alias(runs))
    rows = documents.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row)), "left")
    lines = _lines(F.col("text"))
    index = F.sequence(F.lit(0), F.size(lines) - 1)
    covered = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1)))
    rows = rows.withColumn(kept, F.when(F.col(runs).isNull(), index).otherwise(F.array_except(index, covered))).withColumn("n_lines", F.size(lines).cast("long"))
    rows = rows.withColumn("n_removed", F.col("n_lines") - F.size(kept))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return rows.withColumn("text", text).drop(doc, row, runs, kept)


#: DuckDB form of op9's rows with windows of 2 lines, and of one line of over 50 words; {documents} names the table.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
  FROM {documents}
), pairs AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM lines
), later AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS gone
  FROM pairs WHERE run IS NOT NULL AND regexp_matches(run, '[^\x20\x09-\x0D]')
), long AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS gone
  FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(a.gone, false) OR coalesce(b.gone, false) OR coalesce(c.gone, false) AS gone
  FROM lines l
  LEFT JOIN long c ON c.doc_id = l.doc_id AND c.pos = l.pos
  LEFT JOIN later a ON a.doc_id = l.doc_id AND a.pos = l.pos
  LEFT JOIN later b ON b.doc_id = l.doc_id AND b.pos = l.pos - 1
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
