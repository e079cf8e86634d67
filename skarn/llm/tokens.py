"""Token counts through distinct pre-tokens, and cached encoding of pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's tokens are those of its pre-tokens.
`count_tokens` encodes every distinct pre-token of the corpus once, stores (hash, count) as sorted
hash arrays in the shared folder, and joins each document's pre-token frequencies to them by mapped
lookups; ids of documents never exist and texts are never shuffled.

Null and empty texts have no tokens. A text of any length is cut whole. Null ids are kept; repeated rows are
counted each. An empty table gives no rows.
Only the id and the text are read, so other columns cannot clash. Special strings inside texts are
what the library makes of them by default (one special token).
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections import Counter
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import U64, MappedTable, mapped_folder, parts_for, text_blocks

#: Fixed value: the pattern by which this kind of vocabulary cuts texts before it merges.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HELD_PIECES = 120_000  # pre-tokens whose ids a worker keeps
HELD_COUNTS = 300_000  # pre-tokens whose numbers of tokens a worker keeps


def _byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Encodes single pre-tokens by a byte-level BPE file of the tokenizers library.

    Where the ids of merged pieces follow the order of the merges, the id is the merge rank and the
    merges run on a rank table, several times as fast for single pieces; else the library runs them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}
        vocab, spelled = file["model"]["vocab"], _byte_of_char()
        ranks = {bytes(spelled[c] for c in piece): i for piece, i in vocab.items() if piece not in self.specials}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]]
        singles = sum(len(piece) == 1 for piece in ranks)
        if [vocab[m] for m in merges] == list(range(singles, singles + len(merges))) and not file["model"].get("ignore_merges"):
            import tiktoken

            self.merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self.merge = lambda piece: library.encode(piece, add_special_tokens=False).ids

    def encode(self, piece: str) -> list[int]:
        return [self.specials[piece]] if piece in self.specials else self.merge(piece)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cutter:
    """Cuts texts into pre-tokens; special strings are pieces of their own."""

    def __init__(self, path: str):
        specials = tuple(vocabulary(path).specials)
        self.findall = regex.compile(PIECE_PATTERN).findall
        self.specials = specials
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")").split if specials else None

    def __call__(self, text: str) -> list[str]:
        if not any(s in text for s in self.specials):
            return self.findall(text)
        pieces: list[str] = []
        for part in self.split(text):
            if part in self.specials:
                pieces.append(part)
            else:
                pieces += self.findall(part)
        return pieces


class PieceIds(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes; encodes what it has not seen."""

    def __init__(self, path: str):
        self.encode = vocabulary(path).encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= HELD_PIECES:
            self.clear()
        ids = array("I", self.encode(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        self[piece] = out = ids.tobytes()
        return out


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """One for each worker."""
    return PieceIds(path)


def piece_hash(piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece.encode())


def _texts(batches):
    for rows, data, offs in text_blocks(batches):
        yield rows, data, offs, ("" if t is None else t for t in rows.column("text").to_pylist())


def _distinct_pieces(path: str, parts: int):
    def run(batches):
        cut = Cutter(path)
        seen: set[str] = set()

        def flush():
            dealt: dict[int, list[str]] = {}
            for p in seen:
                dealt.setdefault((piece_hash(p) >> 32) * parts >> 32, []).append(p)
            yield pa.RecordBatch.from_arrays([pa.array(list(dealt), pa.int32()), pa.array(list(dealt.values()), pa.list_(pa.string()))], ["part", "pieces"])

        for _, _, _, texts in _texts(batches):
            for text in texts:
                seen.update(cut(text))
            if len(seen) > HELD_COUNTS:
                yield from flush()
                seen.clear()
        if seen:
            yield from flush()

    return run


def _encode_once(path: str, table: MappedTable):
    def run(rows: pa.Table) -> pa.Table:
        pieces = sorted({p for some in rows.column("pieces").to_pylist() for p in some})
        encode = vocabulary(path).encode
        counts = np.array([len(encode(p)) for p in pieces])
        keys = np.array([piece_hash(p) for p in pieces], U64)
        order = np.argsort(keys)
        part = rows.column("part")[0].as_py()
        table.write(part, keys[order], counts[order])
        return pa.Table.from_arrays([pa.array([part], pa.int32()), pa.array([len(pieces)], pa.int64())], ["part", "pieces"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_pieces, over_limit of every row."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    parts = parts_for(source, 1.0)
    table = MappedTable(mapped_folder(spark, "pieces"), parts, ("u4",))
    table.seal(source.select("text").mapInArrow(_distinct_pieces(path, parts), "part int, pieces array<string>").groupBy("part").applyInArrow(_encode_once(path, table), "part int, pieces long"))

    def run(batches):
        cut, known = Cutter(path), {}
        for rows, _, offs, texts in _texts(batches):
            frequencies = [Counter(cut(t)) for t in texts]
            pieces = set().union(*frequencies)
            if len(known) > HELD_COUNTS:
                known = {}
            if new := list(pieces.difference(known)):
                found, n = table.lookup(np.array([piece_hash(p) for p in new], U64))
                if not found.all():
                    raise RuntimeError("the table of pre-tokens is not whole")
                known.update(zip(new, n.tolist(), strict=True))
            totals = np.array([sum(map(mul, map(known.__getitem__, f), f.values())) for f in frequencies], np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(totals), pa.array([sum(f.values()) for f in frequencies], pa.int64()), pa.array(totals > limit)],
                ["doc_id", "n_bytes", "n_tokens", "n_pieces", "over_limit"],
            )

    return source.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, n_pieces long, over_limit boolean")
