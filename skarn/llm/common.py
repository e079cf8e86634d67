"""Shared pieces: the shared folder, Arrow text blocks, vectorised hashing, mapped hash tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
BLOCK_BYTES = 1 << 20  # text handled at once by the vectorised code; a longer document is its own block


# ---------------------------------------------------------------- shared folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`).

    Where none is set, a local master gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        sc.setCheckpointDir(named)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/skarn/{name}-{uuid.uuid4().hex}"


def mapped_folder(spark: SparkSession, name: str) -> str:
    """A fresh local path in the shared folder, for files that workers map into memory.

    Mapping needs a folder that every node sees as a file system (NFS, FUSE mount and the like).
    """
    uri = new_folder(spark, name)
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    elif "://" in uri:
        raise ValueError(f"memory-mapped tables need a mounted spark.checkpoint.dir, not {uri}")
    os.makedirs(uri, exist_ok=True)
    return uri


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(col, n: int):
    """crc32 of a column's text form mod n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of df and more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def plain_names(df: DataFrame) -> DataFrame:
    """df with columns named by their places, so that no name clashes with one that an operator adds."""
    return df.toDF(*(f"__c{i}" for i in range(len(df.columns))))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- Arrow text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """(rows, bytes, offsets) in blocks of about limit bytes, whole rows each."""
    for batch in batches:
        data, offs = text_buffers(batch.column(column))
        first = 0
        while first < len(batch):
            last = int(np.searchsorted(offs, offs[first] + limit, "right")) - 1
            last = min(len(batch), max(first + 1, last))
            yield batch.slice(first, last - first), data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
            first = last


# ---------------------------------------------------------------- hashing

_STEP = 6364136223846793005  # odd multiplier of the polynomial hash
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse mod 2**64, 0 to n; kept by each worker."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
                out = np.full(size, base, U64)
                out[0] = 1
                _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hash takes the hash of any byte range."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        value = np.take(BYTE_VALUES, data)
        value *= up[: len(data)]
        np.cumsum(value, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end); equal bytes hash alike wherever they stand."""
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * down[start] + (np.asarray(end) - np.asarray(start)).astype(U64) * U64(0xD6E8FEB86659FD93))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_ranges(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-blank bytes inside rows, and words per row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    off = blank[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, off[:-1]
    after[-1], after[:-1] = True, off[1:]
    cut = offs[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    on = ~off
    starts = np.flatnonzero(on & before)
    return starts, np.flatnonzero(on & after) + 1, np.diff(np.searchsorted(starts, offs))


# ---------------------------------------------------------------- mapped tables


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash, monotone in the hash."""
    return ((h >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def write_atomic(path: str, *arrays: np.ndarray) -> None:
    """Arrays of equal length in one file; a task that is run again puts the same file in place."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.array([len(arrays[0])], np.int64).tofile(f)
        for a in arrays:
            np.ascontiguousarray(a).tofile(f)
    os.replace(part, path)


class MappedTable:
    """Sorted 64-bit keys with value columns, one file a part; lookups map the files.

    Keys fall into parts by themselves, or by a second hash that deals them. `seal` writes down which
    parts have a file, so that a file that is missing later is an error and not an empty part.
    """

    def __init__(self, folder: str, parts: int, kinds: tuple[str, ...]):
        self.folder, self.parts, self.kinds = folder, parts, kinds
        self._maps: dict[int, tuple] = {}
        self._sealed: np.ndarray | None = None

    def __getstate__(self):
        return {"folder": self.folder, "parts": self.parts, "kinds": self.kinds, "_maps": {}, "_sealed": None}

    def path(self, part: int) -> str:
        return f"{self.folder}/{part}.bin"

    def write(self, part: int, keys: np.ndarray, *values: np.ndarray) -> None:
        write_atomic(self.path(part), keys.astype(U64), *(v.astype(k) for v, k in zip(values, self.kinds, strict=True)))

    def seal(self, stored: DataFrame | set[int]) -> None:
        """Runs the job that writes the parts (its column part names them), or takes their numbers, and notes which there are."""
        numbers = {r.part for r in stored.select("part").collect()} if isinstance(stored, DataFrame) else stored  # a number for each part
        there = np.zeros(self.parts, np.uint8)
        there[sorted(numbers)] = 1
        write_atomic(f"{self.folder}/parts", there)

    def remove(self) -> None:
        shutil.rmtree(self.folder)

    def part(self, part: int) -> tuple:
        if part not in self._maps:
            if self._sealed is None:
                self._sealed = np.fromfile(f"{self.folder}/parts", np.uint8)[8:]
            if not self._sealed[part]:  # no key fell into this part
                self._maps[part] = (np.zeros(0, U64), *(np.zeros(0, k) for k in self.kinds))
            else:
                raw = np.memmap(self.path(part), np.uint8, "r")
                n, at, found = int(raw[:8].view(np.int64)[0]), 8, []
                for kind in ("u8", *self.kinds):
                    size = n * np.dtype(kind).itemsize
                    found.append(raw[at : at + size].view(kind))
                    at += size
                self._maps[part] = tuple(found)
        return self._maps[part]

    def lookup(self, keys: np.ndarray, fill: int = 0, deal: np.ndarray | None = None) -> list[np.ndarray]:
        """[found, *values] for each key; the keys are sorted first, so that pages are read in order."""
        part = part_of(keys if deal is None else deal, self.parts)
        order = np.argsort(keys) if deal is None else np.lexsort((keys, part))
        keys_in_order, part = keys[order], part[order]
        found = np.zeros(len(keys), bool)
        values = [np.full(len(keys), fill, k) for k in self.kinds]
        some = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for a, b in zip(some.tolist(), [*some[1:].tolist(), len(part)], strict=False):
            table, *columns = self.part(int(part[a]))
            if not len(table):
                continue
            at = np.minimum(np.searchsorted(table, keys_in_order[a:b]), len(table) - 1)
            hit = table[at] == keys_in_order[a:b]
            rows = order[a:b][hit]
            found[rows] = True
            for v, c in zip(values, columns, strict=True):
                v[rows] = c[at[hit]]
        return [found, *values]


PART_BYTES = 4 << 20  # input bytes, as the plan estimates them, for each part of a mapped table
_UNKNOWN = 1 << 60  # estimates from here on are none


def parts_for(df: DataFrame, factor: float = 1.0, least: int = 8) -> int:
    """Number of parts of a mapped table: follows the input's bytes, so that a part's size does not grow with it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, round(factor * (size / PART_BYTES if size < _UNKNOWN else df.rdd.getNumPartitions())))
