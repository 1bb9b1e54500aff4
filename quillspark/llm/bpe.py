"""Byte-pair encoding of a corpus with a public vocabulary, merged over a segment tree.

Each pre-token is a row of bytes. Leaf *i* of the tree holds the rank of the pair that starts at byte *i*
(infinite where no token starts or the pair is no token); inner nodes hold the smaller of their children.
The leftmost smallest pair is found by walking down from the root, and merging it changes three leaves:
the pair's own, its right part's (which dies) and its left neighbour's. A pre-token of n bytes therefore
costs O(n log n), whatever its length.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.util import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of up to so many characters are remembered, so many per worker.
REMEMBER_CHARS, REMEMBER = 48, 60_000
NEVER = 1 << 30


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class SegmentTreeBpe:
    """Encoder for one vocabulary; text that looks like a special token is ordinary text."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        after = list(range(1, n + 1))  # where the token that starts at a byte ends
        before = list(range(-1, n))  # where the token left of that one starts
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = rank_of(piece[i : i + 2], NEVER)
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a <= b else b

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (least := tree[1]) != NEVER:
            node = 1
            while node < size:
                node *= 2
                if tree[node] != least:
                    node += 1
            left = node - size
            right = after[left]
            end = after[right]
            after[left] = end
            put(right, NEVER)
            if end < n:
                before[end] = left
                put(left, rank_of(piece[left : after[end]], NEVER))
            else:
                put(left, NEVER)
            if (prior := before[left]) >= 0:
                put(prior, rank_of(piece[prior:end], NEVER))
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; the empty list for an empty and for a null text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self.known
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[piece] = got
            ids.extend(got)
        return ids


@lru_cache(maxsize=2)
def _encoder(content: bytes) -> SegmentTreeBpe:
    return SegmentTreeBpe(parse_ranks(content))


def read_vocabulary(path: str | None = None) -> bytes:
    """Content of a vocabulary file; by default byte_bpe_50k of the public tokenizers."""
    with open(path or os.path.join(TOKENIZER_DIR, VOCABULARY), "rb") as file:
        return file.read()


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (id_col, ids) per row of ``docs``: the token ids of the text.

    Null and empty texts give the empty list; rows with a null or repeated id are kept as they are; other
    columns are ignored. The vocabulary (under 1 MB, fixed) is read by the driver and broadcast. No shuffle
    but, for inputs with fewer splits than cores, one that spreads the rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = [encode(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "ids"])

    from pyspark.sql import types as T

    out = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    picked = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")), "id")
    return picked.mapInArrow(run, out).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str | None = None) -> DataFrame:
    """One row (id_col, *keep, n_tokens) per row of ``docs``; the same encoder as :func:`encode_corpus`."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = [id_col, *keep]
    out = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode
        for batch in batches:
            counts = [len(encode(text)) for text in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    picked = docs.select(*(F.col(c) for c in names), F.col(text_col).cast("string").alias("__body"))
    return spread(picked, id_col).mapInArrow(run, out)
