"""SimHash near-duplicates: fingerprints, links by deletion-variant signatures, connected groups.

Fingerprints that differ in at most DISTANCE = 3 of 64 bits are cut into two segments, so that one
segment differs in at most one bit. Each distinct fingerprint is indexed under both segments as they
are and under every one-wildcard variant of them (one bit deleted); an equality of keys brings the
candidates together, and the full distance is verified. Candidates of a key are never paired out:
within a key, a search takes the not yet reached fingerprints at once and emits a spanning forest of
the links. Keys of more than LARGE fingerprints are split again by variants of the other segment.

Links are those of distinct fingerprints, which are the nodes; groups are formed by alternating large and small
stars, each round a table in the shared folder. Nothing of the corpus comes to the driver but counts.

Null and empty texts have the fingerprint zero and link like others. Texts of fewer than the shingle's
words are one shingle; texts of any length are hashed whole. Ids may be of any type that has an order.
Rows that share an id are grouped each by its own text. Rows of null id take part; a group of null ids
only has a null component. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, text_blocks, written

SHINGLE, DISTANCE, SEED = 3, 3, 42
SMALL, LARGE = 64, 20_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    pairs = list(zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True))
    return majority(np.array([digest(line[a:b], SEED) for a, b in pairs[at : at + (1 << 16)]], "<u8") for at in range(0, n, 1 << 16))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """64 bits, each 1 if set in over half of the hashes of all blocks."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed long."""

    def run(batches):
        for rows, data, offs in text_blocks(batches):
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1], offs[1:], strict=True)], U64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


# ---------------------------------------------------------------- links


def near(a: np.ndarray, b: np.ndarray | U64, distance: int = DISTANCE) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) that connect what chains of near fingerprints connect.

    Large sets share half of their bits; they are split by one-wildcard variants of the other half's
    two 16-bit parts, of which one differs in at most one bit.
    """
    if len(fps) > LARGE:
        low, high = fps & U64(0xFFFFFFFF), fps >> U64(32)
        half = low if len(np.unique(low)) > len(np.unique(high)) else high
        out = []
        for part in (half & U64(0xFFFF), half >> U64(16)):
            for wild in range(17):
                key = part & ~U64(1 << wild) if wild < 16 else part
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                for own in np.split(order, cuts):
                    if len(own) > 1:
                        out += [(int(own[a]), int(own[b])) for a, b in _search(fps[own])]
        return out
    return _search(fps)


def _search(fps: np.ndarray) -> list[tuple[int, int]]:
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(fps[left], fps[at])
            found = left[hit].tolist()
            out += [(at, b) for b in found]
            todo += found
            left = left[~hit]
    return out


def _link(batches):
    """Spanning links of each key's fingerprints; rows come sorted by key."""
    held: tuple[np.ndarray, ...] | None = None

    def links(key, fp, node):
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cuts)
        a = cuts[:-1][sizes == 2]
        a = a[near(fp[a], fp[a + 1])]
        left, right = [node[a]], [node[a + 1]]
        for k in np.flatnonzero(sizes > 2):
            own = slice(cuts[k], cuts[k + 1])
            found = spanning(fp[own])
            if found:
                x, y = np.array(found).T
                left.append(node[own][x])
                right.append(node[own][y])
        left, right = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.maximum(left, right), np.minimum(left, right)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    for batch in batches:
        own = tuple(np.asarray(batch.column(c)) for c in ("key", "fp", "node"))
        own = (own[0], own[1].view(U64), own[2])
        if held is not None:
            own = tuple(np.concatenate([x, y]) for x, y in zip(held, own, strict=True))
        if not len(own[0]):
            continue
        last = int(np.searchsorted(own[0], own[0][-1]))
        held = tuple(x[last:] for x in own)
        if last:
            yield links(*(x[:last] for x in own))
    if held is not None and len(held[0]):
        yield links(*held)


def variant_keys(fp, segments: int = 2):
    """Keys of a fingerprint: its segments as they are and with each bit deleted.

    Fingerprints of at most 2 * segments - 1 differing bits share one.
    """
    keys, width = [], 64 // segments
    for segment in range(segments):
        bits, at = F.shiftrightunsigned(fp, segment * width).bitwiseAND(F.lit((1 << width) - 1)), segment * 64
        keys.append(bits.bitwiseOR(F.lit((at + width) << 32)))
        keys += [bits.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).bitwiseOR(F.lit((at + i) << 32)) for i in range(width)]
    return F.array(*keys)


def links(distinct: DataFrame) -> DataFrame:
    """Links u > v between nodes of distinct (fp, node)."""
    keyed = distinct.select(F.explode(variant_keys(F.col("fp"))).alias("key"), "fp", "node")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node it is connected to, for every node that an edge (u, v) has."""
    edges, before = written(edges, "links"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()
        edges = written(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    ids = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")  # a row for each fingerprint
    roots = components(links(ids.select("fp", F.col("fp").alias("node"))))
    named = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
