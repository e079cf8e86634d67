"""Exact removal of repeated strings: every byte covered by a LENGTH-byte string that starts elsewhere too.

Suffix arrays over the candidates' bytes decide what is repeated; anchors only bring candidates together,
so that the corpus is never shuffled. Each LENGTH-byte window has an anchor, its least GRAM-byte piece by
hash, so equal windows have equal anchors at equal places. The windows of one anchor form a unit; its
bytes are its context, and the piece that all its windows share is its key.

1. One pass counts keys and contexts, by hash and pre-aggregated per task. What meets another stands as
   sorted hash arrays in the shared folder, with two occurrences to speak for each distinct context.
2. The second pass sends the bytes of these two to the suffix arrays. Contexts that share a key but not
   all bytes meet by their key; where a key has one context only, neighbouring units for which the same
   two rows speak make one stretch and meet by that pair of rows. What meets makes one text, whose suffix
   array is built by linear grouping (`suffix_groups`); a window is repeated exactly if a neighbour in it
   begins with the same LENGTH bytes, which are compared as bytes.
3. The third pass looks every unit up among the contexts with repeated windows, by 128 bits of hash.

A key of more than KEY_CONTEXTS distinct contexts (a line that very many texts share) is never compared
in one task: its units are split in halves by the place of the anchor in the window. Halves share longer
pieces, meet under keys of their own, and equal ones are again represented by two, so that a unit of one
window, the last step, never has more than two to compare.

Matches never cross rows. Windows are judged on the input. Null texts count as empty; texts shorter
than LENGTH lose nothing, and a text of any length is handled whole. Rows are told apart by (doc_id,
text); rows equal in both repeat each other and all get the same result. Null ids are kept as they are.
An empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    U64,
    MappedTable,
    mapped_folder,
    mix,
    part_of,
    parts_for,
    powers,
    prefix_hash,
    range_hash,
    text_blocks,
    written,
)
from .kneser_ney import runs
from .suffix_groups import ranges, suffix_arrays

LENGTH, GRAM = 400, 128
GRAMS = LENGTH - GRAM + 1  # pieces in a window
KEY_CONTEXTS = 16  # distinct contexts of one key that are compared at once
PAIR_BYTES = 1 << 15  # two rows of at most so many bytes are compared by stretches
BATCH, BATCH_TEXTS = (1 << 19, 1 << 21), 250  # symbols, at least and at most, and texts whose suffix arrays are built at once
FLUSH = 400_000
SPLIT = 0xFFFF  # stands for the windows of a context whose unit was split
_LOW = U64((1 << 24) - 1)


class Units:
    """Runs of windows lo..hi (positions in data) of one anchor, whose places in the windows lie in [near, far]."""

    def __init__(self, prefix: np.ndarray, row, anchor, lo, hi, near, far):
        self.row, self.anchor, self.lo, self.hi, self.near, self.far = row, anchor, lo, hi, near, far
        with np.errstate(over="ignore"):
            shared = range_hash(prefix, anchor - near, anchor - far + LENGTH)
            self.key = mix(shared + near.astype(U64) * U64(0x632BE59BD9B4E019))
            self.context = mix(range_hash(prefix, lo, hi + LENGTH) + (anchor - lo).astype(U64) * U64(0x9FB21C651E98DF25) + self.key)

    def __len__(self) -> int:
        return len(self.row)

    def halves(self, prefix: np.ndarray, some: np.ndarray) -> Units:
        """The units some, split by the middle of [near, far]."""
        row, anchor, lo, hi, near, far = (x[some] for x in (self.row, self.anchor, self.lo, self.hi, self.near, self.far))
        middle = (near + far) // 2
        low = [row, anchor, np.maximum(lo, anchor - middle), hi, near, middle]
        high = [row, anchor, lo, np.minimum(hi, anchor - middle - 1), middle + 1, far]
        row, anchor, lo, hi, near, far = (np.concatenate(x) for x in zip(low, high, strict=True))
        real = lo <= hi
        return Units(prefix, *(x[real] for x in (row, anchor, lo, hi, near, far)))


def units(data: np.ndarray, offs: np.ndarray) -> tuple[Units, np.ndarray]:
    """Units of all windows, and the prefix sums that hash data."""
    n = len(data)
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH or np.diff(offs).max() < LENGTH:
        return Units(prefix, none, none, none, none, none, none), prefix
    with np.errstate(over="ignore"):
        order = (prefix[GRAM:] - prefix[:-GRAM]) * powers(n)[1][: n - GRAM + 1]  # the pieces' polynomial hashes
    order &= ~_LOW
    order |= np.arange(len(order), dtype=U64) & _LOW  # ties go to the first
    padded = np.full(-(-len(order) // GRAMS) * GRAMS, ~U64(0))
    padded[: len(order)] = order
    tiles = padded.reshape(-1, GRAMS)
    forward = np.minimum.accumulate(tiles, axis=1).ravel()
    backward = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(backward[:windows], forward[GRAMS - 1 : GRAMS - 1 + windows])
    start = np.arange(windows, dtype=U64)
    anchor = (start + ((least - start) & _LOW)).view(np.int64)
    long = np.flatnonzero(np.diff(offs) >= LENGTH)
    valid = np.zeros(windows + 1, np.int8)
    valid[offs[long]] += 1
    valid[np.minimum(offs[long + 1] - LENGTH + 1, windows)] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    lo = np.flatnonzero(new)
    stop = np.flatnonzero(valid & ~np.concatenate([valid[1:], [False]]))
    hi = np.minimum(np.concatenate([lo[1:], [windows]]) - 1, stop[np.searchsorted(stop, lo)])
    row = np.searchsorted(offs, lo, "right") - 1
    return Units(prefix, row, anchor[lo], lo, hi, np.zeros(len(lo), np.int64), np.full(len(lo), GRAMS - 1)), prefix


def checks(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64 more bits of hash of contexts, of another kind."""
    raw = memoryview(np.ascontiguousarray(data))
    found = [hashlib.blake2b(raw[a : b + LENGTH], digest_size=8).digest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), U64)


# ---------------------------------------------------------------- candidates


def _owner(rows: pa.RecordBatch, u: Units, offs: np.ndarray) -> np.ndarray:
    """A number for each occurrence of a unit: 40 bits of the row's hash, whether the row is long, the place in it."""
    ids = mix(np.asarray(rows.column("row_key")).view(U64))[u.row] & ~_LOW
    long = (np.diff(offs) > PAIR_BYTES)[u.row].astype(U64) << U64(23)
    return ids | long | ((u.lo - offs[u.row]).astype(U64) & U64((1 << 23) - 1))


def _distinct(key, context, n, least, most) -> tuple[np.ndarray, ...]:
    """One entry for each key and context: occurrences, the least and the greatest of their numbers."""
    order = np.lexsort((context, key))
    key, context = key[order], context[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1])]))
    return key[new], context[new], np.add.reduceat(n[order], new), np.minimum.reduceat(least[order], new), np.maximum.reduceat(most[order], new)


def _count(parts: int):
    names = ["part", "key", "context", "n", "least", "most"]

    def run(batches):
        held: list = []
        size = 0

        def flush():
            key, context, owner = (np.concatenate([h[k] for h in held]) for k in range(3))
            found = _distinct(key, context, np.ones(len(key), np.int64), owner, owner)
            cuts = np.searchsorted(part_of(found[0], parts), np.arange(parts + 1))
            some = np.flatnonzero(cuts[:-1] < cuts[1:]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([a[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for a in found)], names)

        for rows, data, offs in text_blocks(batches):
            u, _ = units(data, offs)
            if len(u):
                held.append((u.key, u.context, _owner(rows, u, offs)))
                size += len(u)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _candidates(table: MappedTable):
    """Stores contexts that stand more than once or meet another of their key: context, flags, speakers.

    Flags: copies, 4 for a key of too many contexts, 8 for units that meet by their pair of rows.
    """

    def run(rows: pa.Table) -> pa.Table:
        def joined(name, kind):
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

        part = rows.column("part")[0].as_py()
        key, context, n, least, most = _distinct(joined("key", U64), joined("context", U64), joined("n", np.int64), joined("least", U64), joined("most", U64))
        first = runs(key)
        kinds = np.diff(np.concatenate([first, [len(key)]]))
        kinds = np.repeat(kinds, kinds)
        keep = np.flatnonzero((kinds > 1) | (n > 1))
        keep = keep[np.argsort(context[keep])]
        copies = np.where((n > 1) & (least == most), 2, 1)  # all in equal rows, at the same place
        short = ((least | most) & U64(1 << 23)) == 0
        flags = copies[keep] + 4 * (kinds[keep] > KEY_CONTEXTS) + 8 * ((kinds == 1) & (copies == 1) & short)[keep]
        table.write(part, context[keep], flags, least[keep], most[keep])
        return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([len(keep)], pa.int64())], ["part", "n"])

    return run


#: A stretch of bytes and its units: contexts, checks, first and last windows as arrays. Near, far and left
#: (bytes before the anchor) are those of a single unit.
_STRETCH = "key long, contexts binary, checks binary, first binary, last binary, near int, far int, left int, copies int, hot boolean, bytes binary"
_NAMES = [f.split()[0] for f in _STRETCH.split(", ")]


def _rows_of(u: Units, heads: np.ndarray, sizes: np.ndarray, key: np.ndarray, data: np.ndarray, copies: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Stretches of the units heads, heads + 1, ... (sizes of them)."""
    lo, end = u.lo[heads], u.hi[heads + sizes - 1] + LENGTH
    some = ranges(heads, sizes)
    check = checks(data, u.lo[some], u.hi[some])
    base = np.repeat(lo, sizes)
    cuts = np.concatenate([[0], np.cumsum(sizes)])

    def packed(values: np.ndarray) -> pa.Array:
        raw, n = values.tobytes(), values.itemsize
        return pa.array([raw[n * a : n * b] for a, b in pairwise(cuts.tolist())], pa.binary())

    columns = [pa.array(key.view(np.int64)), packed(u.context[some]), packed(check), packed((u.lo[some] - base).astype(np.int32)), packed((u.hi[some] - base).astype(np.int32))]
    columns += [pa.array(x.astype(np.int32)) for x in (u.near[heads], u.far[heads], u.anchor[heads] - lo, copies)]
    raw = [data[a:b].tobytes() for a, b in zip(lo.tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(hot), pa.array(raw, pa.binary())], _NAMES)


def _speakers(table: MappedTable):
    """The bytes of two occurrences of each candidate."""

    def run(batches):
        sent: set[int] = set()  # rows that are equal to earlier ones of the task have nothing to add
        for rows, data, offs in text_blocks(batches):
            u, _ = units(data, offs)
            found, flags, least, most = table.lookup(u.context, deal=u.key)
            owner = _owner(rows, u, offs)
            at = np.flatnonzero(found & ((owner == least) | (owner == most)))
            own = owner[at].tolist()
            at = at[np.array([x not in sent for x in own], bool)]
            sent.update(own)
            paired = flags[at] >= 8
            with np.errstate(over="ignore"):
                key = np.where(paired, mix((least[at] >> U64(24)) * U64(0x9E3779B97F4A7C15) + (most[at] >> U64(24))), u.key[at])
            same = np.zeros(len(at), bool)  # goes on with the stretch of the unit before
            same[1:] = paired[1:] & paired[:-1] & (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1) & (u.lo[at[1:]] == u.hi[at[:-1]] + 1)
            head = np.flatnonzero(~same)
            size = np.diff(np.concatenate([head, [len(at)]]))
            for some in np.array_split(np.arange(len(head)), len(head) // 5000 + 1):
                h = head[some]
                yield _rows_of(u, at[h], size[some], key[h], data, flags[at[h]] & 3, (flags[at[h]] & 4) > 0)

    return run


def _halves(batches):
    """Halves of the units of hot keys."""
    for batch in batches:
        for rows, data, offs in text_blocks([batch], "bytes", 1 << 20):
            if not len(rows):
                continue
            left, near, far, copies = (np.asarray(rows.column(c)).astype(np.int64) for c in ("left", "near", "far", "copies"))
            lo, hi, prefix = offs[:-1], offs[1:] - LENGTH, prefix_hash(data)
            whole = Units(prefix, np.arange(len(rows)), lo + left, lo, hi, near, far)
            u = whole.halves(prefix, np.arange(len(rows)))
            yield _rows_of(u, np.arange(len(u)), np.ones(len(u), np.int64), u.key, data, copies[u.row], np.zeros(len(u), bool))


def once(stretches: DataFrame) -> DataFrame:
    """One row for equal units of a key, with at most two copies."""
    same = [n for n in _NAMES if n not in ("copies", "hot", "bytes")]
    return stretches.groupBy(same).agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("hot").alias("hot"), F.first("bytes").alias("bytes")).select(_NAMES)


def split_hot(rows: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Stretches to compare, and contexts that were split, from those of the second pass."""
    cold, split = [rows.filter("NOT hot AND copies = 1"), once(rows.filter("NOT hot AND copies = 2"))], []
    hot = rows.filter("hot")
    while not hot.isEmpty():  # at most log2(GRAMS) + 1 rounds
        split.append(hot.select("contexts", "checks").distinct())
        halves = written(once(hot.mapInArrow(_halves, _STRETCH)), "halves")
        kinds = halves.groupBy("key").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")).filter("kinds > 1 OR most > 1")
        halves = written(halves.join(kinds, "key").withColumn("hot", F.col("kinds") > KEY_CONTEXTS).select(_NAMES), "halves")
        cold.append(halves.filter(~F.col("hot")))
        hot = halves.filter("hot")
    return cold, split


# ---------------------------------------------------------------- suffix arrays


def equal_windows(flat: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the LENGTH symbols from p on equal those from q on, for positions p in ascending order."""
    equal = np.ones(len(p), bool)
    for k in (LENGTH - 1, 0, LENGTH // 2, LENGTH - 2):  # leaves few pairs that differ
        equal &= flat[p + k] == flat[q + k]
    at = np.flatnonzero(equal)
    if not len(at):
        return equal
    a, shift = p[at], q[at] - p[at]
    new = np.flatnonzero(np.concatenate([[True], (shift[1:] != shift[:-1]) | (a[1:] > a[:-1] + LENGTH)]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    width = a[last] - a[new] + LENGTH  # neighbouring windows of one shift are compared as one stretch
    stretch = np.repeat(np.arange(len(new)), last - new + 1)
    base = np.cumsum(width) - width
    place = ranges(a[new], width)
    wrong = np.concatenate([[0], np.cumsum(flat[place] != flat[place + np.repeat(shift[new], width)])])
    begin = base[stretch] + a - a[new][stretch]
    equal[at] = wrong[begin + LENGTH] == wrong[begin]
    return equal


def batches_of(sizes: np.ndarray) -> list[np.ndarray]:
    """Texts of like size by batch."""
    out, own, symbols = [], [], 0
    for i in np.argsort(sizes, kind="stable").tolist():
        own.append(i)
        symbols += int(sizes[i])
        if symbols >= BATCH[1] or (symbols >= BATCH[0] and len(own) >= BATCH_TEXTS):
            out.append(np.array(own))
            own, symbols = [], 0
    return [*out, np.array(own)] if own else out


def repeated_windows(keys: np.ndarray, raw: list[bytes], copies: np.ndarray) -> list[np.ndarray]:
    """For stretches of sorted keys: which windows of each stand elsewhere in the stretches of its key.

    A stretch of two copies counts as standing twice.
    """
    edges = np.concatenate([runs(keys), [len(keys)]])
    entry = np.repeat(np.arange(len(raw)), copies)
    symbols = np.array([len(x) for x in raw], np.int64)[entry] + 1
    total = np.concatenate([[0], np.cumsum(symbols)])
    cuts = np.searchsorted(entry, edges)  # entries of each key
    sizes = total[cuts[1:]] - total[cuts[:-1]]
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(raw)
    for texts in batches_of(sizes):
        own = entry[ranges(cuts[texts], cuts[texts + 1] - cuts[texts])]
        lengths = np.array([len(raw[i]) for i in own])
        flat = np.frombuffer(b"\0".join([*(raw[i] for i in own.tolist()), b""]), np.uint8).astype(np.uint16) + 3
        ends = np.cumsum(lengths + 1)
        flat[ends - 1] = 2  # between stretches
        offs = np.concatenate([[0], np.cumsum(sizes[texts])])
        flat[offs[1:] - 1] = 1  # the end of a text
        order = suffix_arrays(flat, offs) + np.repeat(offs[:-1], np.diff(offs))
        window = np.zeros(len(flat), bool)
        window[ranges(ends - 1 - lengths, lengths - LENGTH + 1)] = True
        new = np.zeros(len(flat), bool)
        new[offs[:-1]] = True
        at = np.flatnonzero(window[order[1:]] & window[order[:-1]] & ~new[1:])
        p, q = order[at + 1], order[at]
        by = np.argsort(p)
        p, q = p[by], q[by]
        equal = equal_windows(flat, p, q)
        repeated = np.zeros(len(flat), bool)
        repeated[p[equal]] = repeated[q[equal]] = True
        for i, end, n in zip(own.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            out[i] = repeated[end - 1 - n : end - LENGTH]  # copies have equal results
    return out


def _compare(rows: pa.Table) -> pa.Table:
    """context, check, first, last of the runs of repeated windows, counted from the context's first."""
    order = np.argsort(rows.column("key").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    key, copies = rows.column("key").to_numpy(), rows.column("copies").to_numpy().astype(np.int64)
    found = repeated_windows(key, rows.column("bytes").to_pylist(), copies)
    parts: list[tuple[np.ndarray, ...]] = []
    for windows, *arrays in zip(found, *(rows.column(c).to_pylist() for c in _NAMES[1:5]), strict=True):
        if not windows.any():
            continue
        context, check, first, last = (np.frombuffer(x, kind) for x, kind in zip(arrays, (np.int64, np.int64, np.int32, np.int32), strict=True))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], windows.astype(np.int8), [0]])))
        a, b = edge[::2], edge[1::2] - 1
        # units that each run meets
        i, j = np.searchsorted(last, a), np.searchsorted(first, b, "right")
        unit, run = ranges(i, j - i), np.repeat(np.arange(len(a)), j - i)
        parts.append((context[unit], check[unit], np.maximum(a[run], first[unit]) - first[unit], np.minimum(b[run], last[unit]) - first[unit]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 4
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["context", "check", "first", "last"])


# ---------------------------------------------------------------- results


def _split(batches):
    for batch in batches:
        own = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int64) for c in ("contexts", "checks"))
        mark = pa.array(np.full(len(batch), SPLIT, np.int64))
        yield pa.RecordBatch.from_arrays([*map(pa.array, own), mark, mark], ["context", "check", "first", "last"])


def _run_key(context: np.ndarray, check: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context + mix(check + np.asarray(k).astype(U64) * U64(0x8CB92BA72F3D8DD7)))


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def repeated_contexts(docs: DataFrame) -> MappedTable:
    """Runs of repeated windows of each context that has any, by (context, number of the run).

    Values: check, number of runs, first and last window; SPLIT stands for the halves of the unit.
    """
    spark = docs.sparkSession
    source = with_row_key(docs).select("row_key", "text")
    parts = parts_for(source, 1.5)
    table = MappedTable(mapped_folder(spark, "candidates"), parts, ("u1", "u8", "u8"))
    counted = source.mapInArrow(_count(parts), "part int, key binary, context binary, n binary, least binary, most binary")
    table.seal(counted.groupBy("part").applyInArrow(_candidates(table), "part int, n long"))

    cold, split = split_hot(written(source.mapInArrow(_speakers(table), _STRETCH), "contexts"))
    contexts = cold[0]
    for more in cold[1:]:
        contexts = contexts.union(more)
    tasks = int(contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0) // (8 << 20) + 8
    compared = contexts.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("task")).applyInArrow(_compare, "context long, check long, first long, last long")
    for more in split:
        compared = compared.union(more.mapInArrow(_split, "context long, check long, first long, last long"))
    by_context = compared.groupBy("context", "check").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # of one context

    parts = max(8, parts // 8)
    out = MappedTable(mapped_folder(spark, "repeated"), parts, ("u8", "u2", "u2", "u2"))

    def deal(batches):
        for batch in batches:
            rows: list[tuple] = []
            for context, check, own in zip(batch.column("context").to_pylist(), batch.column("check").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                own = sorted((s["first"], s["last"]) for s in own)
                rows += [(context, check, k, len(own), a, b) for k, (a, b) in enumerate(own)]
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] or [np.zeros(0, np.int64)] * 6
            key = _run_key(columns[0].view(U64), columns[1].view(U64), columns[2])
            yield pa.RecordBatch.from_arrays([pa.array(part_of(key, parts).astype(np.int32)), pa.array(key.view(np.int64)), *map(pa.array, (columns[1], *columns[3:]))], ["part", "key", "check", "n", "first", "last"])

    def store(rows: pa.Table) -> pa.Table:
        key = rows.column("key").to_numpy().view(U64)
        order = np.argsort(key)
        part = rows.column("part")[0].as_py()
        check = rows.column("check").to_numpy().view(U64)
        out.write(part, key[order], check[order], *(rows.column(c).to_numpy()[order] for c in ("n", "first", "last")))
        return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([len(order)], pa.int64())], ["part", "n"])

    out.seal(by_context.mapInArrow(deal, "part int, key long, check long, n long, first long, last long").groupBy("part").applyInArrow(store, "part int, n long"))
    table.remove()
    return out


def spans_of(table: MappedTable, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, start and end (positions in data) of maximal repeated byte ranges."""
    u, prefix = units(data, offs)
    row, start, end = [], [], []
    while len(u):
        check = checks(data, u.lo, u.hi)
        key = _run_key(u.context, check, 0)
        found, own, n, first, last = table.lookup(key)
        found &= own == check
        halve = found & (first == SPLIT)
        at = np.flatnonzero(found & ~halve)
        more = np.maximum(n[at].astype(np.int64) - 1, 0)
        again, number = np.repeat(at, more), ranges(np.ones(len(at), np.int64), more)
        _, _, _, first_of, last_of = table.lookup(_run_key(u.context[again], check[again], number))
        at, first, last = np.concatenate([at, again]), np.concatenate([first[at], first_of]), np.concatenate([last[at], last_of])
        row.append(u.row[at])
        start.append(u.lo[at] + first)
        end.append(u.lo[at] + last + LENGTH)
        u = u.halves(prefix, np.flatnonzero(halve))
    if not row:
        return (np.zeros(0, np.int64),) * 3
    row, start, end = map(np.concatenate, (row, start, end))
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    # positions ascend with the row, so ends do so too
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]))
    return row[new], start[new], reach[np.concatenate([new[1:], [len(row)]]) - 1]


def with_row_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("row_key"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept: remaining bytes) of every row."""
    table = repeated_contexts(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for rows, data, offs in text_blocks(batches):
            row, start, end = spans_of(table, data, offs)
            cuts = np.searchsorted(row, np.arange(len(rows) + 1))
            removed, digest, kept, spans = np.zeros(len(rows), np.int64), [], [], []
            for i, (a, b) in enumerate(pairwise(cuts.tolist())):
                own = data[offs[i] : offs[i + 1]]
                raw = own.tobytes()
                if a < b:
                    edges = [0, *np.stack([start[a:b], end[a:b]], axis=1).ravel() - offs[i], len(own)]
                    raw = b"".join(own[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                    removed[i] = len(own) - len(raw)
                digest.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    kept.append(raw)
                    spans.append([{"start": int(x - offs[i]), "end": int(y - offs[i])} for x, y in zip(start[a:b], end[a:b], strict=True)])
            columns = [rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed), pa.array(np.diff(cuts).astype(np.int64)), pa.array(digest, pa.string())]
            if with_text:
                columns += [pa.array(spans, pa.list_(pair)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names + (["spans", "kept"] if with_text else []))

    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, fields + (", spans array<struct<start:long,end:long>>, kept binary" if with_text else ""))


#: The same rows in DuckDB SQL: digests of all windows, written out in hexadecimal.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, md5(substring(h, 2 * s + 1, {2 * LENGTH})) AS m
  FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - {LENGTH})) AS s FROM d WHERE len(h) >= {2 * LENGTH})
), hit AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1
), run AS (
  SELECT doc_id, s, sum(CASE WHEN s <= last + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS island
  FROM (SELECT doc_id, s, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -{2 * LENGTH}) AS last FROM hit)
), span AS (
  SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(s)) AS k FROM run GROUP BY doc_id, island
), gap AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY k)
  UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id
), sums AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id
), rest AS (
  SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a, b NULLS LAST) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
