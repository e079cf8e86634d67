"""Interpolated modified Kneser-Ney language model, counted in Spark, mapped by the scoring workers.

Texts become 64-bit word hashes with vectorised code. Each task counts the word pairs of its texts,
pre-aggregated, and deals them by (context, slice of the word): a very frequent context is spread
over SLICES parts, and only sums of it meet again. The parts are stored as sorted hash arrays in the
shared folder; workers map them and look up sorted blocks of pairs, so nothing is broadcast and
memory does not grow with the model.

The model is of order two. Its statistics cover all training rows; no count is pruned.

Null and empty texts are one end token. Null ids fall into the held-out fold. Repeated rows count as
often as they stand there. An empty training set gives the uniform distribution. Columns other than
the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    LOWER,
    U64,
    MappedTable,
    crc_bucket,
    mapped_folder,
    mix,
    part_of,
    parts_for,
    prefix_hash,
    range_hash,
    text_blocks,
    with_fields,
    word_ranges,
)

SLICES = 8
MANY = 255
BEGIN, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
FLUSH_TOKENS = 1_500_000


def token_stream(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, their contexts, and row offsets."""
    low = LOWER[data]
    starts, ends, per_row = word_ranges(low, offs)
    words = range_hash(prefix_hash(low), starts, ends)
    at = np.concatenate([[0], np.cumsum(per_row + 1)])
    tokens = np.empty(at[-1], U64)
    last = np.zeros(at[-1], bool)
    last[at[1:] - 1] = True
    tokens[last], tokens[~last] = END, words
    context = np.empty(at[-1], U64)
    context[1:] = tokens[:-1]
    context[at[:-1]] = BEGIN
    return tokens, context, at


def pair_keys(context: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dealing key of (context, slice of the word), and the pair's own hash.

    Both share the upper 16 bits, and the number of parts is a power of two, so both name one part.
    """
    with np.errstate(over="ignore"):
        deal = mix(context + (tokens % U64(SLICES) + U64(1)) * U64(0x9E3779B97F4A7C15))
        own = mix(deal * U64(3) + tokens)
    return deal, (deal & U64(0xFFFF000000000000)) | (own & U64(0x0000FFFFFFFFFFFF))


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _count_pairs(parts: int):
    def count(batches):
        held: list = []
        size = 0

        def flush():
            context, tokens = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            deal, _ = pair_keys(context, tokens)
            order = np.argsort((deal & U64(0xFFFFFFFFFF000000)) | (tokens >> U64(40)))
            deal, context, tokens = deal[order], context[order], tokens[order]
            new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (tokens[1:] != tokens[:-1])]))
            counts = np.diff(np.concatenate([new, [len(tokens)]])).astype(np.uint32)
            deal, context, tokens = deal[new], context[new], tokens[new]
            cuts = np.searchsorted(part_of(deal, parts), np.arange(parts + 1))
            some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    *(pa.array([a[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary()) for a in (context, tokens, counts)),
                ],
                ["part", "context", "token", "n"],
            )

        for _, data, offs in text_blocks(batches):
            tokens, context, _ = token_stream(data, offs)
            held.append((context, tokens))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return count


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _merge_pairs(pairs: MappedTable, many: MappedTable, word_parts: int):
    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        context, tokens, n = _joined(table.column("context"), U64), _joined(table.column("token"), U64), _joined(table.column("n"), np.uint32)
        _, own = pair_keys(context, tokens)
        order = np.argsort(own)
        own = own[order]
        new = runs(own)
        n = np.add.reduceat(n[order].astype(np.int64), new)
        own, context, tokens = own[new], context[order][new], tokens[order][new]
        pairs.write(part, own, np.minimum(n, MANY))
        often = n >= MANY
        many.write(part, own[often], n[often])
        of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5].astype(np.int64)
        rows: list = [(-1, 2, np.int64(part).tobytes(), b"", of_counts.tobytes(), b"")]

        order = np.argsort(context)
        new = runs(c := context[order])
        k = n[order]
        ones, twos, more = (np.add.reduceat(x.astype(np.uint32), new, dtype=np.uint32) for x in (k == 1, k == 2, k > 2))
        total = np.add.reduceat(k, new).astype(np.int64)
        c = c[new]
        cuts = np.searchsorted(part_of(c, word_parts), np.arange(word_parts + 1))
        for p in range(word_parts):
            if (a := cuts[p]) < (b := cuts[p + 1]):
                rows.append((p, 1, c[a:b].tobytes(), total[a:b].tobytes(), np.stack([ones[a:b], twos[a:b], more[a:b]]).tobytes(), b""))

        order = np.argsort(tokens)
        new = runs(t := tokens[order])
        raw, kinds = np.add.reduceat(n[order], new).astype(np.int64), np.diff(np.concatenate([new, [len(t)]])).astype(np.uint32)
        t = t[new]
        cuts = np.searchsorted(part_of(t, word_parts), np.arange(word_parts + 1))
        for p in range(word_parts):
            if (a := cuts[p]) < (b := cuts[p + 1]):
                rows.append((p, 0, t[a:b].tobytes(), raw[a:b].tobytes(), kinds[a:b].tobytes(), b""))
        return pa.Table.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()), (3, pa.binary()), (4, pa.binary()))],
            ["word_part", "kind", "h", "total", "counts"],
        )

    return merge


def _merge_words(words: MappedTable):
    def merge(table: pa.Table) -> pa.Table:
        part = table.column("word_part")[0].as_py()
        names = ["word_part", "tokens", "types", "cont", "pairs"]
        kinds, h, total, counts = (table.column(k).to_pylist() for k in ("kind", "h", "total", "counts"))
        if part < 0:
            found = np.sum([np.frombuffer(x, np.int64) for x in counts], axis=0)
            return pa.Table.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([np.frombuffer(b"".join(h), np.int64).tolist()], pa.list_(pa.int64())), pa.array([found.tolist()], pa.list_(pa.int64()))], names)
        keys, columns = [], []
        for kind, a, b, c in zip(kinds, h, total, counts, strict=True):
            a = np.frombuffer(a, U64)
            block = np.zeros((6, len(a)), np.int64)  # raw, continuation, ones, twos, more, total as context
            if kind == 0:
                block[0], block[1] = np.frombuffer(b, np.int64), np.frombuffer(c, np.uint32)
            else:
                block[5] = np.frombuffer(b, np.int64)
                block[2:5] = np.frombuffer(c, np.uint32).reshape(3, -1)
            keys.append(a)
            columns.append(block)
        keys, block = np.concatenate(keys), np.concatenate(columns, axis=1)
        order = np.argsort(keys)
        new = runs(keys := keys[order])
        block = np.add.reduceat(block[:, order], new, axis=1)
        keys = keys[new]
        raw = np.where(keys == BEGIN, block[5], block[0])  # a word is a context as often as it stands there
        words.write(part, keys, raw, *block[1:5])
        seen = block[0] > 0
        cont = block[1][seen]
        return pa.Table.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([int(block[0].sum())], pa.int64()),
                pa.array([int(seen.sum())], pa.int64()),
                pa.array([np.bincount(np.minimum(cont, 5), minlength=6)[1:5].tolist() + [int((cont > 2).sum()), int(cont.sum())]], pa.list_(pa.int64())),
                pa.array([[0] * 4], pa.list_(pa.int64())),
            ],
            names,
        )

    return merge


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of the modified form, kept inside (0, k) where counts of counts are few."""
    if not n1 or not n2:
        return (0.5, 0.75, 0.75)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


@dataclass
class Model:
    pairs: MappedTable  # counts in a byte, MANY and above in a table of their own
    many: MappedTable
    words: MappedTable
    tokens: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: tuple[int, int, int]  # words of one, two, more contexts
    pair_types: int

    def score_block(self, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        tokens, context, at = token_stream(data, offs)
        unique, where = np.unique(np.concatenate([tokens, context]), return_inverse=True)
        _, raw, cont, ones, twos, more = self.words.lookup(unique)
        of_token, of_context = where[: len(tokens)], where[len(tokens) :]
        keys = pair_keys(context, tokens)[1]
        _, n = self.pairs.lookup(keys)
        n = n.astype(np.int64)
        often = np.flatnonzero(n == MANY)
        n[often] = self.many.lookup(keys[often])[1]

        def cut(d, k):
            return np.array([0.0, *d])[np.minimum(k, 3)]

        k = cont.astype(np.int64)
        if self.pair_types:
            spare = float(np.dot(self.word_discounts, self.word_mass)) / self.pair_types
            unigram = (k - cut(self.word_discounts, k)) / self.pair_types + spare / (self.types + 1)
        else:
            unigram = np.full(len(unique), 1.0 / (self.types + 1))
        mass = (ones * self.pair_discounts[0] + twos * self.pair_discounts[1] + more * self.pair_discounts[2])[of_context]
        total = np.where(mass > 0, raw[of_context], 0).astype(float)
        safe = np.maximum(total, 1)
        p = np.where(total > 0, (n - cut(self.pair_discounts, n) + mass * unigram[of_token]) / safe, unigram[of_token])
        c = raw[of_token].astype(float)
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        return {
            "n_tokens": np.diff(at),
            "n_known": np.add.reduceat((c > 0).astype(np.int64), at[:-1]),
            "base_score": np.add.reduceat(base, at[:-1]),
            "score": np.add.reduceat(np.log10(p), at[:-1]),
        }


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts over all rows of docs. Null texts count as empty; an empty table gives a uniform model."""
    spark = docs.sparkSession
    source = docs.select(F.col(text).alias("text"))
    parts = 1 << (parts_for(source, 1.5) - 1).bit_length()
    word_parts = max(4, parts // 4)
    folder = mapped_folder(spark, "lm")
    for name in ("pairs", "many", "words"):
        os.makedirs(f"{folder}/{name}", exist_ok=True)
    pairs = MappedTable(f"{folder}/pairs", parts, ("u1",))
    many = MappedTable(f"{folder}/many", parts, ("u8",))
    words = MappedTable(f"{folder}/words", word_parts, ("u8", "u4", "u4", "u4", "u4"))
    counted = source.mapInArrow(_count_pairs(parts), "part int, context binary, token binary, n binary")
    merged = counted.groupBy("part").applyInArrow(_merge_pairs(pairs, many, word_parts), "word_part int, kind int, h binary, total binary, counts binary")
    sums = merged.groupBy("word_part").applyInArrow(_merge_words(words), "word_part int, tokens long, types long, cont array<long>, pairs array<long>").collect()  # a row for each part
    cont, of_pairs = np.zeros(6, np.int64), np.zeros(4, np.int64)
    words.seal({r.word_part for r in sums if r.word_part >= 0})
    for table in (pairs, many):
        table.seal({p for r in sums if r.word_part < 0 for p in r.cont})
    for r in sums:
        if r.word_part >= 0:
            cont[: len(r.cont)] += np.array(r.cont)
        of_pairs += np.array(r.pairs)
    return Model(pairs, many, words, sum(r.tokens for r in sums), sum(r.types for r in sums), discounts(*map(int, of_pairs)), discounts(*map(int, cont[:4])), (int(cont[0]), int(cont[1]), int(cont[4])), int(cont[5]))


def score(model: Model, docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row."""

    def run(batches):
        for rows, data, offs in text_blocks(batches, "__text"):
            got = model.score_block(data, offs)
            n = len(rows)
            arrays = [rows.column(k) for k in range(len(keep))] + [
                pa.array(got["n_tokens"], pa.int64()),
                pa.array(got["n_known"], pa.int64()),
                pa.array(np.full(n, model.tokens), pa.int64()),
                pa.array(got["base_score"]),
                pa.array(got["score"]),
                pa.array(10.0 ** np.minimum(-got["score"] / got["n_tokens"], 300)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    source = docs.select(*keep, F.col(text).alias("__text"))
    return source.mapInArrow(run, with_fields(docs.select(*keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"))


def held_out_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Fits on the rows outside fold 0 of crc32(doc_id) and scores every row."""
    fold = docs.select("doc_id", "text").withColumn("held_out", crc_bucket(F.col("doc_id"), folds) == 0)
    return score(fit(fold.filter(~F.col("held_out"))), fold, keep=("doc_id", "held_out"))
