"""Near copies: SimHash brings word shingle sets together, exact Jaccard similarity decides, no pair of SIMILAR is missed.

A text is its set of shingles of WIDTH words, as 64-bit hashes in ascending order.

1. Each set has a fingerprint (`simhash.majority` of its shingles). Fingerprints of at most DISTANCE
   bits share a deletion variant of one of SEGMENTS segments; such sets are linked if their similarity is at
   least 4/5, which the sets themselves decide. Connected sets are a group.
2. Fingerprints promise nothing about pairs, so an exact way links what is left between groups. Whatever
   the order of shingles, two sets of n and m shingles that reach 4/5 share one of the first
   n - ceil(4n/5) + 1 of the one and of the other (prefix filtering). Sets of one group are not compared
   again. Common shingles come last in the order, so that a passage that very many texts share
   is no key of texts that hold more than it. Which are common is counted in a share of the sets; it decides
   about work only.

Within a key pairs are never written out: a search takes what the reached set is similar to and emits
links of a spanning forest. A pair of the second step is compared by size, then by parity bitmaps, whose
differing bits never exceed the differing shingles, and what is left by the sets themselves.

Sets stand once for each task and text in files of the shared folder, which workers map; a set's name
is its place there. Groups are formed as in simhash. Words are bytes between blanks, ASCII letters
lowered. Texts of fewer words are one shingle; null and empty texts have the empty set and are one
group. A text of any length is handled whole. Rows are told apart by set and id, so rows that share an
id stay if their texts are no copies; of rows that share both, one stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, MappedTable, mapped_folder, mix, part_of, prefix_hash, range_hash, text_blocks, word_ranges, written
from .simhash import components, majority, near, variant_keys

WIDTH = 5
OVER, UNDER = 4, 5  # similarity of near copies, as a fraction
DISTANCE, SEGMENTS = 7, 4  # bits between fingerprints that meet; at DISTANCE < 2 * SEGMENTS one segment differs in at most one bit
TOGETHER = 64  # keys of at most so many fingerprints are searched in array operations over all of them
BITMAP = 16  # words of 64 bits
SAMPLED, COMMON = 16, 12  # one set in so many is counted; a shingle in more of these comes last
_AT = 36  # bits of a place inside a file
_FACTOR = U64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The set of each row, ascending."""
    data = LOWER[data]
    starts, ends, counts = word_ranges(data, offs)
    words = range_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, U64)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):

        def joined(rows: np.ndarray, n: int) -> np.ndarray:
            out = np.full(len(rows), n, U64)
            for k in range(n):
                out = mix(out * _FACTOR + words[rows + k])
            return out

        whole = joined(np.arange(max(0, len(words) - width + 1)), width)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(np.unique(whole[a : b - width + 1] if b - a >= width else joined(np.array([a]), b - a) if b > a else words[:0]))
    return out


def name_of(own: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(own).sum(dtype=U64) + U64(len(own)) * _FACTOR], U64)).view(np.int64)[0])


def bitmap(own: np.ndarray) -> np.ndarray:
    """For each of 1024 slots, whether an odd number of shingles falls into it."""
    odd = np.bincount((own & U64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set."""
    return majority(own[at : at + (1 << 16)] for at in range(0, len(own), 1 << 16))


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, row (its hash), set (its name), place and fp (fingerprint) of every row, whose sets are written into the folder."""

    def run(batches):
        task, at, places, prints = TaskContext.get().taskAttemptId(), 0, {}, {}
        with open(f"{folder}/{task}.bin", "wb") as f:
            for rows, data, offs in text_blocks(batches):
                names = []
                for own in shingle_sets(data, offs):
                    names.append(name_of(own))
                    if names[-1] not in places:
                        places[names[-1]] = task << _AT | at
                        prints[names[-1]] = fingerprint(own)
                        np.concatenate([np.array([len(own)], U64), bitmap(own), own]).tofile(f)
                        at += 1 + BITMAP + len(own)
                fps = np.array([prints[x] for x in names], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), pa.array(names, pa.int64()), pa.array([places[x] for x in names], pa.int64()), pa.array(fps)], ["doc_id", "row", "set", "place", "fp"])

    source = docs.select("doc_id", "text", row_hash().alias("row"))
    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, set long, place long, fp long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


class Sets:
    """The sets of a folder, mapped."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, {}

    def file(self, task: int) -> np.ndarray:
        if task not in self.files:
            self.files[task] = np.memmap(f"{self.folder}/{task}.bin", U64, "r")
        return self.files[task]

    def at(self, place: int) -> np.ndarray:
        """The shingles."""
        f, at = self.file(place >> _AT), place & ((1 << _AT) - 1)
        return f[at + 1 + BITMAP : at + 1 + BITMAP + int(f[at])]

    def heads(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bitmaps."""
        task, at = places >> _AT, places & ((1 << _AT) - 1)
        sizes, maps = np.empty(len(places), np.int64), np.empty((len(places), BITMAP), U64)
        for t in np.unique(task).tolist():
            own = np.flatnonzero(task == t)
            sizes[own] = self.file(t)[at[own]]
            maps[own] = self.file(t)[at[own, None] + np.arange(1, 1 + BITMAP)]
        return sizes, maps


def prefix(n: int) -> int:
    return n - (OVER * n + UNDER - 1) // UNDER + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return (OVER + UNDER) * both >= OVER * (len(a) + len(b))


def blocks_of(batches, folder: str):
    """Rows and their sets' shingles, of some sets at once."""
    sets = Sets(folder)
    for batch in batches:
        for first in range(0, len(batch), 2000):
            some = batch.slice(first, 2000)
            yield some, [sets.at(p) for p in some.column("place").to_pylist()]


def common_shingles(places: DataFrame, folder: str) -> MappedTable:
    """The shingles that come last, as a mapped table."""

    def count(batches):
        for _, found in blocks_of(batches, folder):
            shingle, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)], ["shingle", "n"])

    counted = places.filter(F.pmod(F.xxhash64("place"), F.lit(SAMPLED)) == 0).mapInArrow(count, "shingle long, n long")
    common = counted.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON).select("shingle")
    parts = 64
    table = MappedTable(mapped_folder(places.sparkSession, "common"), parts, ())

    def deal(batches):
        for batch in batches:
            part = part_of(np.asarray(batch.column("shingle")).view(U64), parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("shingle")], ["part", "shingle"])

    def store(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        table.write(part, np.sort(rows.column("shingle").to_numpy().view(U64)))
        return pa.Table.from_arrays([pa.array([part], pa.int32())], ["part"])

    table.seal(common.mapInArrow(deal, "part int, shingle long").groupBy("part").applyInArrow(store, "part int"))
    return table


def keys(places: DataFrame, folder: str, common: MappedTable) -> DataFrame:
    """key, place and group: each set under the shingles of its prefix."""

    def run(batches):
        for some, sets in blocks_of(batches, folder):
            sizes = np.array([len(s) for s in sets])
            owner, whole = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
            last = common.lookup(whole)[0]
            order = np.argsort(2 * owner + last, kind="stable")
            rank = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = order[rank < np.array([prefix(int(n)) for n in sizes])[owner]]
            if len(kept):
                place, group = (pa.array(np.asarray(some.column(c))[owner[kept]]) for c in ("place", "group"))
                yield pa.RecordBatch.from_arrays([pa.array(whole[kept].view(np.int64)), place, group], ["key", "place", "group"])

    return places.mapInArrow(run, "key long, place long, group long")


def may_be(sizes: np.ndarray, maps: np.ndarray, size, of) -> np.ndarray:
    """Which sets may be similar to others, by their sizes and bitmaps."""
    fits = UNDER * np.minimum(sizes, size) >= OVER * np.maximum(sizes, size)
    differ = np.bitwise_count(maps ^ of).sum(axis=1, dtype=np.int64)
    return np.flatnonzero(fits & ((OVER + UNDER) * differ <= (UNDER - OVER) * (sizes + size)))


class Forest:
    """Links of a spanning forest, over all keys that a task handles."""

    def __init__(self, folder: str):
        self.sets, self.root = Sets(folder), {}

    def grouped(self, places: np.ndarray, groups: np.ndarray) -> None:
        """Takes places as linked to the least of their group."""
        some = np.flatnonzero(places != groups)
        for place, group in zip(places[some].tolist(), groups[some].tolist(), strict=True):
            self.root.setdefault(place, group)

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = up = self.root.get(up, up)
            x = up
        return x

    def joins(self, a: int, b: int) -> bool | None:
        """Whether places are linked: None if they are by earlier links already."""
        x, y = self.find(a), self.find(b)
        if x == y:
            return None
        if not similar(self.sets.at(a), self.sets.at(b)):
            return False
        self.root[max(x, y)] = min(x, y)
        return True

    def pairs(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """New links of pairs of places, a above b."""
        if not len(a):
            return []
        a, b = np.unique(np.stack([a, b], axis=1), axis=0).T  # copies share many keys
        (n, maps), (m, others) = self.sets.heads(a), self.sets.heads(b)
        may = may_be(n, maps, m, others)
        return [x for x in zip(a[may].tolist(), b[may].tolist(), strict=True) if self.joins(*x)]

    def links(self, places: np.ndarray, fps: np.ndarray | None = None) -> list[tuple[int, int]]:
        """New links among the places of one key; if fingerprints are given, only of those that are near."""
        sizes, maps = self.sets.heads(places) if fps is None else (None, None)
        left, out = np.arange(len(places)), []
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                at = todo.pop()
                taken = []
                may = may_be(sizes[left], maps[left], sizes[at], maps[at]) if fps is None else np.flatnonzero(near(fps[left], fps[at], DISTANCE))
                for k in may.tolist():
                    a, b = int(places[at]), int(places[left[k]])
                    found = self.joins(a, b)
                    if found is not False:
                        taken.append(k)
                    if found:
                        out.append((max(a, b), min(a, b)))
                todo += left[taken].tolist()
                left = np.delete(left, taken)
        return out


def links(self, places: list[int]) -> list[tuple[int, int]]:
        """Links that are new among the sets of one key."""
        if len(places) == 2 and self.find(places[0]) == self.find(places[1]):
            return []
        sizes, maps, own = zip(*map(self.sets.at, places), strict=True)
        sizes, maps = np.array(sizes), np.stack(maps)
        left, out = np.arange(len(places)), []
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                at = todo.pop()
                total = sizes[left] + sizes[at]
                may = (UNDER * np.minimum(sizes[left], sizes[at]) >= OVER * np.maximum(sizes[left], sizes[at])).nonzero()[0]
                differ = np.bitwise_count(maps[left[may]] ^ maps[at]).sum(axis=1, dtype=np.int64)
                may = may[(OVER + UNDER) * differ <= (UNDER - OVER) * total[may]]
                taken = []
                for k, b in zip(may.tolist(), left[may].tolist(), strict=True):
                    x, y = self.find(places[at]), self.find(places[b])
                    if x == y:
                        taken.append(k)
                    elif similar(own[at], own[b]):
                        taken.append(k)
                        self.root[max(x, y)] = min(x, y)
                        out.append((max(places[at], places[b]), min(places[at], places[b])))
                todo += left[taken].tolist()
                left = np.delete(left, taken)
        return out


def whole_keys(batches, names: tuple[str, ...]):
    """Columns of the rows of whole keys, and where each key begins, with the end; rows come sorted by key, the first column."""
    rest, whole = [np.zeros(0, np.int64)] * len(names), iter(batches)
    while True:
        batch = next(whole, None)
        if batch is not None:
            columns = [np.concatenate([r, np.asarray(batch.column(c))]) for r, c in zip(rest, names, strict=True)]
            key = columns[0]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        else:
            columns = rest
            key, last = rest[0], len(rest[0])
        rest = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns], np.flatnonzero(np.concatenate([[True], key[1:last] != key[: last - 1], [True]]))
        if batch is None:
            return


def as_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def near_pairs(fps: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of near fingerprints, of keys of at most TOGETHER fingerprints."""
    n = np.diff(cuts)
    behind = np.repeat(np.where(n <= TOGETHER, cuts[1:], cuts[:-1]), n) - np.arange(cuts[-1])  # places to the end of the key
    at, a, b = np.arange(cuts[-1]), [], []
    for k in range(1, TOGETHER):
        at = at[behind[at] > k]
        if not len(at):
            break
        hit = at[near(fps[at], fps[at + k], DISTANCE)]
        a.append(hit)
        b.append(hit + k)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + a), np.concatenate(none + b)


def fingerprint_links(prints: DataFrame, folder: str) -> DataFrame:
    """Links u > v between places of (place, fp): similar sets among those whose fingerprints meet."""

    def run(batches):
        forest = Forest(folder)
        for (_, place, fp), cuts in whole_keys(batches, ("key", "place", "fp")):
            fp = fp.view(U64)
            a, b = (place[x] for x in near_pairs(fp, cuts))
            found = forest.pairs(np.maximum(a, b), np.minimum(a, b))
            for k in np.flatnonzero(np.diff(cuts) > TOGETHER).tolist():
                found += forest.links(place[cuts[k] : cuts[k + 1]], fp[cuts[k] : cuts[k + 1]])
            yield as_batch(found)

    keyed = prints.select(F.explode(variant_keys(F.col("fp"), SEGMENTS)).alias("key"), "place", "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def links(keyed: DataFrame, folder: str) -> DataFrame:
    """Links u > v between places of different groups."""

    def run(batches):
        forest = Forest(folder)
        for (_, place, group), cuts in whole_keys(batches, ("key", "place", "group")):
            n = np.diff(cuts)
            new = np.minimum.reduceat(group, cuts[:-1]) != np.maximum.reduceat(group, cuts[:-1])  # keys of more than one group
            own = np.repeat(new, n)
            forest.grouped(place[own], group[own])
            two = cuts[:-1][new & (n == 2)]
            found = forest.pairs(np.maximum(place[two], place[two + 1]), np.minimum(place[two], place[two + 1]))
            for k in np.flatnonzero(new & (n > 2)).tolist():
                found += forest.links(place[cuts[k] : cuts[k + 1]])
            yield as_batch(found)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs but near copies: of each group the row of the smallest id stays, once; null ids come last."""
    folder = mapped_folder(docs.sparkSession, "shingles")
    rows = written(stored(docs, folder), "sets")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    sets = written(rows.groupBy("set").agg(best, F.min("place").alias("node"), F.first("fp").alias("fp")), "distinct")
    alike = components(fingerprint_links(sets.select(F.col("node").alias("place"), "fp"), folder))
    places = written(sets.select("node").join(alike, "node", "left").select(F.col("node").alias("place"), F.coalesce("root", "node").alias("group")), "places")
    rest = links(keys(places, folder, common_shingles(places, folder)), folder)
    roots = components(alike.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest))
    first = sets.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("best").alias("best"))
    first = first.select(F.col("best.row").alias("__row"))
    return docs.withColumn("__row", row_hash()).join(first, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
