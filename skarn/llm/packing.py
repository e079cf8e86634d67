"""Packing of documents into sequences of a fixed number of tokens, by a configuration LP.

A configuration says how many pieces of each length one sequence holds. The LP over configurations
covers the length histogram by as few sequences as can be. It is solved by multiplicative weights in
ROUNDS steps, after each of which an even share more of every length should be covered: a length that
lags weighs exponentially more, and the pricing problem, the configuration of greatest weight, is a
bounded knapsack solved by dynamic programming. One table of it prices the best configuration with
each length in it, so a step uses one for every length that lags. The fractional solution is rounded
to whole sequences, the fraction of one configuration carrying over to the next, and the LP is solved
again for the pieces that rounding left, until few are left; these are placed by best fit. Of the
numbers of times that the LP may be solved, none included, that of the fewest sequences is taken, so
there are never more sequences than by best fit alone.

Only the histogram (one row a length) reaches the driver, and the plan that returns is bounded by the
number of LP steps and lengths, whatever the input; pieces find their place by their rank among pieces
of their length.

A document is its ids and the end id. One longer than the capacity is cut into full pieces; what is
over comes first, as a shorter first piece. A text of any length is handled whole, in one task. Null and
empty texts are the end id alone. Null ids are packed like others. Repeated rows are packed each. An
empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks, written
from .tokens import Cutter, piece_ids

END_ID = 2
ROUNDS, RATE = 160, 3.0  # steps of the LP; growth of the weight of a length by what it lags, as its logarithm
FEE = 0.2  # taken from a piece's weight, as a share of the mean length: short pieces are kept to fill gaps
SOLVE, FEW = 8, 0.02  # LPs at most; the last is the one that places less than so large a share
ENOUGH = 0.8  # share of the pieces from which on configurations must be full


def cut_pieces(docs: DataFrame, path: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, part, k (and ids).

    k counts the pieces of the same length in the same task, part is that task's number.
    """

    def run(batches):
        cut, ids = Cutter(path), piece_ids(path)
        end = np.array([END_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, _, _ in text_blocks(batches):
            out: list[tuple] = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                whole = memoryview(b"".join(map(ids.__getitem__, cut(text or ""))) + end)
                n, start, piece = len(whole) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    own = whole[4 * start : 4 * (start + length)]
                    out.append((doc, piece, start, length, zlib.crc32(own), part, seen[length], bytes(own) if with_ids else None))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            columns = list(zip(*out, strict=True))
            kinds = [rows.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k", "ids"]
            some = len(names) if with_ids else len(names) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns[:some], kinds, strict=False)], names[:some])

    source = docs.select("doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, k long"
    return source.mapInArrow(run, schema + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------- the plan


class Pricing:
    """The configurations of greatest worth, within every room, that hold at most `most` pieces of each length."""

    def __init__(self, lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int):
        self.items: list[tuple[int, int, int]] = []  # length number, pieces, size: bundles of 1, 2, 4, ... pieces
        value, gains = np.zeros(capacity + 1), []
        for i, (length, w, n) in enumerate(zip(lengths.tolist(), worth.tolist(), np.minimum(most, capacity // lengths).tolist(), strict=True)):
            bundle = 1
            while n > 0 and w > 0:
                bundle = min(bundle, n)
                self.items.append((i, bundle, bundle * length))
                gains.append(bundle * w)
                n -= bundle
                bundle *= 2
        self.last = np.full((len(self.items) + 1, capacity + 1), -1, np.int32)  # last bundle taken, of the first ones
        for j, ((_, _, size), gain) in enumerate(zip(self.items, gains, strict=True)):
            got = value[:-size] + gain
            better = got > value[size:]
            np.copyto(value[size:], got, where=better)
            self.last[j + 1] = self.last[j]
            self.last[j + 1, size:][better] = j

    def best(self, room: int) -> tuple[dict[int, int], int]:
        """Pieces by length number, and the room they leave."""
        config: dict[int, int] = {}
        j = len(self.items)
        while (j := int(self.last[j, room])) >= 0:
            i, n, size = self.items[j]
            config[i] = config.get(i, 0) + n
            room -= size
        return config, room


def solve_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, waste: int = 0) -> list[tuple[dict[int, int], float]]:
    """Configurations that leave at most waste, and how often to use each: a fractional cover of counts.

    Lengths come in descending order, long ones first in every step. What no such configuration can
    cover stays uncovered.
    """
    n, covered = counts.astype(float), np.zeros(len(lengths))
    used: list[tuple[dict[int, int], float]] = []
    for step in range(1, ROUNDS + 1):
        target, beyond = step / ROUNDS, (step + 1) / ROUNDS
        worth = lengths * np.exp(RATE * (target - covered)) - FEE * lengths.mean()
        lag = (target - covered) * n
        table = Pricing(lengths, worth, np.where(lag > 1e-9, np.maximum(1, lag), 0).astype(int), capacity)
        for i in range(len(lengths)):
            for _ in range(3):
                if covered[i] >= target - 1e-9:
                    break
                config, left = table.best(capacity - int(lengths[i]))
                config[i] = config.get(i, 0) + 1
                times = min((target - covered[i]) * n[i] / config[i], *((beyond - covered[k]) * n[k] / m for k, m in config.items()))
                if left > waste or times < 1e-3:
                    break
                for k, m in config.items():
                    covered[k] = min(1.0, covered[k] + times * m / n[k])
                used.append((config, times))
    return used


@dataclass
class Plan:
    """Slots by length: the slots from first on belong to sequences base, base + 1, ... each with per of them from offset on."""

    slots: dict[int, np.ndarray]
    sequences: int
    by_lp: int  # pieces below the capacity that configurations of the LP placed


def configurations(left: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Sequences (length -> pieces, how many such sequences) for pieces by length, and pieces that the LP placed."""
    pieces = int(left.sum())
    bins: list[tuple[dict[int, int], int]] = []
    found: tuple | None = None
    waste = 0
    for solved in range(SOLVE + 1):
        rest = best_fit(left.copy(), capacity)
        n = sum(times for _, times in bins) + sum(times for _, times in rest)
        placed = pieces - int(left.sum())
        if found is None or n <= found[0]:
            found = n, [*bins, *rest], placed
        lengths = np.flatnonzero(left)[::-1]
        if solved == SOLVE or not len(lengths):
            break
        before, carry = placed, 0.5
        for config, x in solve_lp(lengths, left[lengths], capacity, waste):
            times = min(int(x + carry), *(int(left[lengths[i]]) // m for i, m in config.items()))
            carry = min(x + carry - times, 1.0)
            if times > 0:
                bins.append(({int(lengths[i]): m for i, m in config.items()}, times))
                for i, m in config.items():
                    left[lengths[i]] -= times * m
        placed = pieces - int(left.sum())
        if placed - before < FEW * pieces:
            if placed >= ENOUGH * pieces:
                break
            waste = 2 * waste + 1  # full configurations do not suffice
    return found[1], found[2]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    bins: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        bins.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    rest, by_lp = configurations(left, capacity)
    bins += rest
    slots: dict[int, list] = {}
    filled, base = np.zeros(capacity + 1, np.int64), 0
    for config, times in bins:
        offset = 0
        for length in sorted(config, reverse=True):
            n = config[length]
            slots.setdefault(length, []).append((filled[length], base, n, offset))
            filled[length] += times * n
            offset += n * length
        base += times
    return Plan({k: np.array(v, np.int64) for k, v in slots.items()}, base, by_lp)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, over the histogram: groups of equal sequences are filled together."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # room -> groups
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if groups.get(r)), None)
            if room is None:
                per = capacity // length
                whole, over = divmod(n, per)
                for times, each in ((whole, per), (1 if over else 0, over)):
                    if times:
                        groups.setdefault(capacity - each * length, []).append(({length: each}, times))
                n = 0
                continue
            config, times = groups[room].pop()
            each = min(room // length, n)
            take = min(times, n // each)
            if take < times:
                groups[room].append((config, times - take))
            groups.setdefault(room - each * length, []).append((config | {length: config.get(length, 0) + each}, take))
            n -= take * each
    return [g for some in groups.values() for g in some]


# ---------------------------------------------------------------- placing


def pack(docs: DataFrame, path: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    pieces = written(cut_pieces(docs, path, capacity, with_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    plan = make_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # a row for each length

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                table = plan.slots[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + k // row[:, 2]
                offset[at] = row[:, 3] + k % row[:, 2] * n
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), (F.col("k") + F.col("before")).alias("rank"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, fields + ", sequence_id long, offset long")
