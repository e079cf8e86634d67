"""Removal of repeated runs of lines, by a suffix array over line-id sequences. DataFrame operations only.

A document is its sequence of non-blank lines, each an id. Ranks of the runs of 1, 2, 4, ... lines
that begin at each position are built by prefix doubling: a run of twice the length ranks as the pair
of its halves' ranks, and pairs are ranked by a range-partitioned sort. Positions whose run stands
nowhere else leave, so that only repeated text is sorted again. Ranks of two overlapping runs of 2^k
lines name the interval of suffixes that share any number of lines from 2^k to 2^(k+1).

A repeated run counts if it holds at least `min_chars` characters. The minimal runs of that size, from
each line on and up to each line, are compared by these intervals; every later copy (in the order of
doc_id, then text hash, then line) is deleted. A line lies in a maximal repeated run of that size, of
which an earlier copy exists, exactly if it lies in such a minimal run, so this deletes later copies
of maximal runs whole, and doubling goes no deeper than the longest minimal run.

Blank lines between deleted lines go with them; others stay. Nothing else of a text changes. Null
texts stay null, empty ones empty. Documents stay, if with an empty text. Rows equal in doc_id and text
count as one document and get one result. Null ids come first. Columns of any name are kept; helper
columns live in tables of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MIN_CHARS = 40  # shorter runs (headings, single words) are no repeats worth a cut
ROW = "__row_key"


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """r, o, at (line number), pos (among non-blank lines), id, before and upto (characters) of non-blank lines."""
    lines = docs.select(row_key().alias("r"), F.col("doc_id").alias("o"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.filter(F.col("line").rlike(r"\S")).select("r", "o", "at", F.xxhash64("line").alias("id"), F.length("line").cast("long").alias("n"))
    lines = lines.repartition("r").dropDuplicates(["r", "at"])
    inside = Window.partitionBy("r").orderBy("at")
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("r", "o", "at", "id", (F.row_number().over(inside) - 1).alias("pos"), (upto - F.col("n")).alias("before"), upto.alias("upto"))


def minimal_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """r, o, first, n: the shortest run of min_chars characters from each line on, and up to each line."""
    forward = Window.partitionBy("r").orderBy("before").rangeBetween(0, min_chars - 1)
    backward = Window.partitionBy("r").orderBy("upto").rangeBetween(1 - min_chars, 0)
    ends = lines.select("r", "o", F.col("pos").alias("a"), F.max("pos").over(forward).alias("b"), (F.max("upto").over(forward) - F.col("before")).alias("size"), F.min("pos").over(backward).alias("c"), (F.col("upto") - F.min("before").over(backward)).alias("size_back"))
    both = F.array(
        F.struct(F.col("a").alias("first"), (F.col("b") - F.col("a") + 1).alias("n"), F.col("size").alias("size")),
        F.struct(F.col("c").alias("first"), (F.col("a") - F.col("c") + 1).alias("n"), F.col("size_back").alias("size")),
    )
    runs = ends.select("r", "o", F.explode(F.array_distinct(F.filter(both, lambda x: x["size"] >= min_chars))).alias("x"))
    return runs.select("r", "o", "x.first", "x.n").dropDuplicates(["r", "first", "n"])


def repeated_ranks(pairs: DataFrame) -> DataFrame:
    """x, y, c: ranks, in order, of the pairs (x, y) that stand more than once."""
    several = pairs.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    ranges = written(several.repartitionByRange("x", "y").withColumn("p", F.spark_partition_id()), "ranks")
    sizes = ranges.groupBy("p").agg(F.count("*").alias("n"))  # a row for each range
    start = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("x", "y"))
    return ranges.withColumn("k", rank).join(F.broadcast(start), "p").select("x", "y", (F.col("start") + F.col("k")).alias("c"))


def later_copies(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """r, first, n of the runs that have an earlier copy."""
    longest = runs.agg(F.max("n")).first()[0] or 0
    found: DataFrame | None = None
    pairs = lines.select("r", "pos", F.col("id").alias("x"), F.lit(0).cast("long").alias("y"))
    step = 1  # lines of the runs that ranks name
    while step <= longest:
        ranks = written(pairs.join(repeated_ranks(pairs), ["x", "y"]).select("r", "pos", "c"), "suffixes")
        own = runs.filter((F.col("n") >= step) & (F.col("n") < 2 * step))
        named = own.join(ranks.select("r", F.col("pos").alias("first"), F.col("c").alias("x")), ["r", "first"])
        if step > 1:
            named = named.withColumn("tail", F.col("first") + F.col("n") - step)
            named = named.join(ranks.select("r", F.col("pos").alias("tail"), F.col("c").alias("y")), ["r", "tail"])
        else:
            named = named.withColumn("y", F.lit(0).cast("long"))
        place = F.struct("o", "r", "first")
        named = written(named.select("r", "o", "first", "n", "x", "y"), "intervals")
        # a table of its own, so that the join below can split the rows of a very common run
        leader = written(named.groupBy("x", "y", "n").agg(F.min(place).alias("leader")), "leaders")
        later = named.join(leader, ["x", "y", "n"]).filter(place > F.col("leader")).select("r", "first", "n")
        found = later if found is None else found.union(later)
        pairs = ranks.select("r", "pos", F.col("c").alias("x")).join(ranks.select("r", (F.col("pos") - step).alias("pos"), F.col("c").alias("y")), ["r", "pos"])
        step *= 2
    return found if found is not None else runs.select("r", "first", "n").limit(0)


def repeated_line_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """r and runs, the line ranges to delete: array of (a, b, lines), for rows that lose any."""
    lines = written(line_table(docs), "lines")
    runs = written(minimal_runs(lines, min_chars), "runs")
    later = later_copies(lines, runs)
    gone = later.select("r", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("pos")).distinct()
    gone = gone.join(lines.select("r", "pos", "at"), ["r", "pos"])
    island = F.col("pos") - F.row_number().over(Window.partitionBy("r").orderBy("pos"))
    spans = gone.withColumn("island", island).groupBy("r", "island").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("lines"))
    return spans.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("a", "b", "lines"))).alias("runs"))


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later copies deleted from text, and __runs, the deleted line ranges (null if none)."""
    found = repeated_line_runs(docs, min_chars).select(F.col("r").alias(ROW), F.col("runs").alias("__runs"))
    joined = docs.withColumn(ROW, row_key()).join(found, ROW, "left").drop(ROW)

    def kept(line: Column, at: Column) -> Column:
        return ~F.exists(F.col("__runs"), lambda s: (at >= s["a"]) & (at <= s["b"]))

    cut = F.array_join(F.filter(F.split("text", "\n", -1), kept), "\n")
    return joined.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(cut))


def digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_runs, n_removed (non-blank lines), kept_chars, kept_sha256 of every row."""
    out = remove_repeated_lines(docs.select("doc_id", "text"), min_chars)
    text = F.coalesce("text", F.lit(""))
    removed = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, x: s + x["lines"])
    return out.select(
        "doc_id",
        F.when(F.col("__runs").isNull(), F.lit(0)).otherwise(F.size("__runs")).cast("long").alias("n_runs"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


#: The same rows in DuckDB SQL. Whole runs of lines are compared as lists.
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, l AS line, length(l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(l, '[^ \\t\\n\\v\\f\\r]')
), seq AS (
  SELECT *, row_number() OVER w - 1 AS pos, sum(n) OVER w AS upto, sum(n) OVER w - n AS before FROM lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT doc_id, pos, list(line) OVER f AS ahead, max(upto) OVER f - before AS ahead_n, list(line) OVER b AS back, upto - min(before) OVER b AS back_n
  FROM seq WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_CHARS - 1} FOLLOWING),
                  b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_CHARS - 1} PRECEDING AND CURRENT ROW)
), runs AS (
  SELECT doc_id, pos AS first, ahead AS run FROM ends WHERE ahead_n >= {MIN_CHARS}
  UNION
  SELECT doc_id, pos - len(back) + 1, back FROM ends WHERE back_n >= {MIN_CHARS}
), later AS (
  SELECT doc_id, first, len(run) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS copy FROM runs) WHERE copy > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, first + n - 1)) AS pos FROM later
), spans AS (
  SELECT doc_id, min(line_no) AS a, max(line_no) AS b, count(*) AS lines FROM (
    SELECT g.doc_id, s.line_no, g.pos - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.pos) AS island
    FROM gone g JOIN seq s USING (doc_id, pos)) GROUP BY doc_id, island
), cuts AS (
  SELECT doc_id, count(*) AS n_runs, CAST(sum(lines) AS BIGINT) AS n_removed, list({{'a': a, 'b': b}}) AS runs FROM spans GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(n_removed, 0) AS n_removed,
         CASE WHEN c.runs IS NULL THEN coalesce(d.text, '')
              ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: len(list_filter(c.runs, lambda s: i - 1 BETWEEN s.a AND s.b)) = 0), chr(10)), '') END AS text
  FROM documents d LEFT JOIN cuts c USING (doc_id)
)
SELECT doc_id, n_runs, n_removed, length(text) AS kept_chars, sha256(text) AS kept_sha256 FROM kept
"""
