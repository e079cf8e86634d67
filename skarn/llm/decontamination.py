"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Texts are normalised to lower-case words with one space between them; the automaton finds every
occurrence of every window of `window` consecutive item words in one pass, and positions in the
normalised text map back to words and to byte offsets of the original text.

The automaton's size follows the benchmark, never the documents. Items are dealt into blocks of at
most `max_bytes` of window text, measured before any worker sees them; there is one automaton unless
the benchmark is larger than that, and then one pass a block, whose hits are merged.

Null and empty texts have no words and no hits. An item without words has no window; an item of
fewer words than a window is one window. Repeated items are counted by id, once. Windows of items
of null id are hits; only the id is left out of the items. Repeated document rows are judged each. An empty benchmark leaves every
document clean. Only the ids and the texts are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, with_fields, written

MAX_BYTES = 6 << 20  # of window text in one automaton, which takes some 50 times as much memory in each worker
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Lower-cases A-Z and blanks what no word holds, byte by byte.
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(text: str | None, window: int) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def benchmark_blocks(benchmark: DataFrame, window: int, max_bytes: int) -> list[list[tuple[str | None, str]]]:
    """(item_id, text) by block. Items are fetched one partition at a time; a block's bytes are bounded."""
    blocks: list[list[tuple[str | None, str]]] = [[]]
    size = 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter(F.col("text").isNotNull())
    for item, text in items.toLocalIterator():
        own = sum(len(w) for w in windows_of(text, window))
        if size + own > max_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += own
    return blocks


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str | None, str], ...], window: int):
    """The automaton of a block; bytes stand as characters 0 to 255, so that positions are bytes."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            owners.setdefault(w, set()).update(() if item is None else (item,))
    automaton = ahocorasick.Automaton()
    for w, ids in owners.items():
        automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def scan(automaton, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, maximal runs of hit words, and items of which a window occurs."""
    words = text.encode().translate(_NORMAL).split()
    if not words or not len(automaton):
        return len(words), [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    at, before = 0, 0  # words that end before position at
    for end, (size, ids) in automaton.iter(line):
        before += line.count(" ", at, end)
        at = end
        items.update(ids)
        first = before - size
        while runs and runs[-1][1] >= first:  # ends ascend; a longer window may reach back
            first = min(first, runs.pop()[0])
        runs.append((first, before))
    return len(words), runs, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, n_words, n_hit, n_items, items_sha256, contaminated, items, spans of every row.

    spans are byte ranges (start, end) of hit words in the original UTF-8 text.
    """
    spark = docs.sparkSession
    name = text if text in keep else "__text"
    extra = [] if text in keep else [name]
    kept = docs.select(*keep)
    out = docs.select(*keep, *(F.col(text).alias(x) for x in extra))
    result = "n_words long, hits array<struct<a:long,b:long>>, items array<string>"
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    blocks = benchmark_blocks(benchmark, window, max_bytes)
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(tuple(block))  # at most max_bytes
        last = k == len(blocks) - 1

        def run(batches, shared=shared, last=last, first=k == 0):
            automaton = _automaton(shared.value, window)
            for rows, data, offs in text_blocks(batches, name):
                texts = rows.column(name).to_pylist()
                n, hits, items = [], [], []
                for i, t in enumerate(texts):
                    words, own, ids = scan(automaton, t or "")
                    if not first:
                        own = merged_runs([*own, *((h["a"], h["b"]) for h in rows.column("hits")[i].as_py())])
                        ids |= set(rows.column("items")[i].as_py())
                    n.append(words)
                    hits.append([{"a": a, "b": b} for a, b in own])
                    items.append(sorted(ids))
                columns = [rows.column(x) for x in keep] + [rows.column(x) for x in ([] if last else extra)]
                columns += [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))]
                names = [*keep, *([] if last else extra), "n_words", "hits", "items"]
                if last:
                    spans = [byte_spans(data[offs[i] : offs[i + 1]], h) for i, h in enumerate(hits)]
                    columns += [
                        pa.array([sum(h["b"] - h["a"] for h in x) for x in hits], pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                        pa.array([bool(x) for x in hits]),
                        pa.array(spans, pa.list_(pair)),
                    ]
                    names += ["n_hit", "n_items", "items_sha256", "contaminated", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names)

        if last:
            end = "n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<a:long,b:long>>"
            return out.mapInArrow(run, with_fields(kept, f"{result}, {end}")).drop("hits")
        out = written(out.mapInArrow(run, with_fields(kept, ", ".join([*(f"{x} string" for x in extra), result]))), "hits")
    raise AssertionError


def merged_runs(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(data: np.ndarray, hits: list[dict]) -> list[dict]:
    """Byte ranges of runs of words."""
    if not hits:
        return []
    on = np.concatenate([[False], _WORD[data], [False]])
    starts, ends = np.flatnonzero(on[1:-1] & ~on[:-2]), np.flatnonzero(on[1:-1] & ~on[2:]) + 1
    return [{"a": int(starts[h["a"]]), "b": int(ends[h["b"] - 1])} for h in hits]


def digests(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    return decontaminate(docs, benchmark, window).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS_SQL = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The same rows in DuckDB SQL: windows as joined strings.
ORACLE_SQL = f"""
WITH item AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS line FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM item)
), doc AS (
  SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), found AS (
  SELECT doc_id, i, n, item_id FROM (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS line FROM (
      SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n))
  JOIN wanted USING (n, line)
), hits AS (
  SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS at_word FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
