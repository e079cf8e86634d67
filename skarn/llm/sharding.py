"""Sharding by sampled splitters, to shards of near-equal bytes.

Records are ordered by (hash of the text, hash of doc_id and row), so that equal texts are neighbours and
any group can be split. A size-weighted
sample of keys, of bounded size, gives quantile splitters; records are range-partitioned by them, and
ranges that came out overfull are subdivided by samples of their own. Inside ranges a window gives
exact running sizes, sums of ranges give exact offsets, and a record's shard follows from the exact
position of its middle byte. So shards differ by about one record whatever the sample was; the sample
only balances the work.

A group of equal texts of at most SNAP of a shard's bytes that a shard boundary would cut goes whole
to the shard of its middle; larger groups are cut where the boundary falls.

Null texts have size 1 (no bytes, plus one). Ids may be null and of any type; only their hash is used.
Repeated rows keep separate slots. A text of any length is one record. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE = 4096  # keys a sample holds
SNAP = 0.002
ROUNDS = 4


def keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"), F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("d"))


def weighted_sample(records: DataFrame, n: int) -> list[tuple[int, int]]:
    """n keys drawn without replacement with chances by size (exponential ranks); repeatable."""
    u = (F.shiftrightunsigned(F.xxhash64("h", "d", F.lit(17)), 11).cast("double") + 1) / float(2**53)
    top = records.select("h", "d", (-F.log(u) / F.col("size")).alias("rank")).orderBy("rank", "h", "d").limit(n)
    return sorted((r.h, r.d) for r in top.select("h", "d").collect())  # bounded by n


def quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def with_range(records: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds range: how many splitters are at or below the record's key."""
    h, d = (np.array([s[k] for s in splitters], np.int64) for k in (0, 1))
    cut_h = np.unique(h)
    first = np.searchsorted(h, cut_h)

    @F.pandas_udf("int")
    def find(a, b):
        x, y = a.to_numpy(), b.to_numpy()
        out = np.searchsorted(h, x, "left")
        tied = np.flatnonzero(np.isin(x, cut_h))
        for i, value in enumerate(cut_h):  # splitters may cut one large group
            at = tied[x[tied] == value] if len(tied) else tied
            if len(at):
                last = first[i + 1] if i + 1 < len(first) else len(h)
                out[at] = first[i] + np.searchsorted(d[first[i] : last], y[at], "right")
        return pd.Series(out.astype(np.int32))

    return records.withColumn("range", find("h", "d") if len(splitters) else F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 8, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    records = written(keyed(docs), "keyed")
    ranges = ranges or max(4 * shards, 2 * records.rdd.getNumPartitions())
    splitters = quantiles(weighted_sample(records, max(SAMPLE, 8 * ranges)), ranges)
    for _ in range(ROUNDS):
        dealt = with_range(records, splitters)
        sums = {r.range: (r.n, r.rows) for r in dealt.groupBy("range").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()}  # a row for each range
        total = sum(n for n, _ in sums.values())
        even = total / ranges
        rows = sum(k for _, k in sums.values()) / ranges
        full = [k for k, (n, c) in sums.items() if n > 3 * even or c > 8 * rows + 1000]
        if not full:
            break
        more = []
        for k in full:
            parts = int(max(sums[k][0] / even, sums[k][1] / rows)) + 1
            more += quantiles(weighted_sample(dealt.filter(F.col("range") == k), 64 * parts), parts)
        new = sorted({*splitters, *more})
        if new == splitters:
            break
        splitters = new
    if not sums:
        total = 0
    before, at = {}, 0
    for k in sorted(sums):
        before[k] = at
        at += sums[k][0]
    start = F.broadcast(records.sparkSession.createDataFrame([(int(k), int(v)) for k, v in before.items()], "range int, start long"))  # a row for each range

    inside = Window.partitionBy("range").orderBy("h", "d", "size", "text_crc32")
    placed = dealt.join(start, "range").repartition(max(1, len(sums)), "range").withColumn("at", (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("start")).cast("long"))
    per = max(total, 1) / shards
    # groups: first byte and bytes of each group of equal texts, which ranges may have cut
    groups = placed.groupBy("h").agg(F.min("at").alias("g_at"), F.sum("size").alias("g_size"))
    cut = groups.filter((F.col("g_size") <= SNAP * per) & (F.floor(F.col("g_at") / per) != F.floor((F.col("g_at") + F.col("g_size") - 1) / per)))
    snapped = {r.h: r.g_at + r.g_size // 2 for r in cut.collect()}  # at most one for each inner boundary
    middle = F.col("at") + F.col("size") / 2
    if snapped:
        snap = F.create_map(*[F.lit(x) for k, v in snapped.items() for x in (k, v)])
        middle = F.coalesce(snap[F.col("h")], middle)
    placed = written(placed.withColumn("shard", F.least(F.floor(middle / per), F.lit(shards - 1)).cast("int")), "placed")

    # slots: rank in (range, shard) plus the rows that earlier ranges gave the shard
    counts = placed.groupBy("range", "shard").agg(F.count("*").alias("n")).collect()  # a few rows for each range
    base, filled = {}, dict.fromkeys(range(shards), 0)
    for r in sorted(counts):
        base[r.range * shards + r.shard] = filled[r.shard]
        filled[r.shard] += r.n

    def number(rows: pa.Table) -> pa.Table:
        shard, at = rows.column("shard").to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, shard))
        slot = np.empty(len(order), np.int64)
        s = shard[order]
        first = np.searchsorted(s, s)
        offset = np.array([base[k] for k in (rows.column("range").to_numpy().astype(np.int64) * shards + shard)[order].tolist()])
        slot[order] = np.arange(len(order)) - first + offset
        return pa.Table.from_arrays([rows.column("doc_id"), rows.column("size"), rows.column("text_crc32"), rows.column("shard"), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = placed.select("doc_id", "size", "text_crc32", "range", "shard", "at").groupBy("range").applyInArrow(number, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
