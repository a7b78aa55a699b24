"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts. Each pair of neighbours that has a merge rank
stands in the bucket of that rank, by the position of its left part; three levels of
64-bit words tell which buckets have entries, so that three find-first-set steps give the
lowest rank. Entries whose pair has changed meanwhile are stale and skipped when they come
up. The cost of a merge doesn't grow with the pre-token's length but for the bucket's own
heap, so that a pre-token of a million bytes takes seconds.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces

#: Distinct pre-tokens whose ids a task remembers before it forgets all of them.
REMEMBERED = 1_000_000


class _Known(dict):
    """The ids of pre-tokens as bytes; those of up to 64 characters are remembered."""

    def __init__(self, merge, most: int):
        self.merge, self.most = merge, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode()).tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for a rank file: lines of a base64 token and its rank."""

    def __init__(self, rank_file: bytes, pattern: str, remembered: int = REMEMBERED):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern).findall
        self.known = _Known(self.merge, remembered)
        words = -(-len(self.tokens) // 64)
        self.low, self.mid, self.buckets = [0] * words, [0] * (-(-words // 64)), {}

    def merge(self, piece: bytes) -> array:
        """The ids of one pre-token."""
        rank, n = self.ranks.get, len(piece)
        if (whole := rank(piece)) is not None:
            return array("i", (whole,))
        low, mid, top, buckets, longest = self.low, self.mid, 0, self.buckets, self.longest
        if n < 4096:
            after, before = list(range(1, n + 2)), list(range(-1, n))
        else:
            after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                if (bucket := buckets.get(r)) is None:
                    buckets[r] = [i]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
                else:
                    bucket.append(i)  # positions rise, so it stays a heap
        while top:
            t = (top & -top).bit_length() - 1
            m = mid[t]
            w = (t << 6) + (m & -m).bit_length() - 1
            b = low[w]
            r = (w << 6) + (b & -b).bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                low[w] &= b - 1
                if not low[w]:
                    mid[t] &= m - 1
                    if not mid[t]:
                        top &= top - 1
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i] = k
            pair[j] = -1
            if k < n:
                before[k] = i
                new = rank(piece[i : after[k]], -1) if after[k] - i <= longest else -1
            else:
                new = -1
            pair[i] = new
            if new >= 0:
                if (bucket := buckets.get(new)) is None:
                    buckets[new] = [i]
                    w = new >> 6
                    low[w] |= 1 << (new & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
                else:
                    heappush(bucket, i)
            if (p := before[i]) >= 0:
                new = rank(piece[p:k], -1) if k - p <= longest else -1
                pair[p] = new
                if new >= 0:
                    if (bucket := buckets.get(new)) is None:
                        buckets[new] = [p]
                        w = new >> 6
                        low[w] |= 1 << (new & 63)
                        mid[w >> 6] |= 1 << (w & 63)
                        top |= 1 << (w >> 6)
                    else:
                        heappush(bucket, p)
        ids, i, ranks = array("i"), 0, self.ranks
        while i < n:
            j = after[i]
            ids.append(ranks[piece[i:j]])
            i = j
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text: those of its pre-tokens, one after another."""
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_made: dict[bytes, Bpe] = {}


def made(rank_file: bytes, pattern: str) -> Bpe:
    """One encoder for each rank file and pattern in a Python worker."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _made:
        _made[key] = Bpe(rank_file, pattern)
    return _made[key]


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, decode: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id, ids`` and, if asked for, ``decoded``, the bytes of the ids.

    Each match of ``pattern`` is encoded separately, without special tokens. Null counts as
    empty, which has no ids; very long texts and pre-tokens are encoded whole; repeated rows give
    repeated results; null ids are kept; an empty table gives none; other columns play no part. The rank file, about a megabyte whatever the input, goes to each executor once.
    """
    with open(rank_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = made(held.value, pattern)
        for batch in pieces(batches):
            ids = [bpe.encode(text) if text else np.empty(0, np.int32) for text in batch.column("text").to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            out = [batch.column("doc_id"), lists]
            if decode:
                out.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    return columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per row of ``encoded`` (``doc_id, ids``): ``doc_id, decoded``.

    Null and empty lists give empty bytes; very long ones are decoded whole; repeated rows give
    repeated results; null doc_ids are kept; an empty table gives none; other columns play no part.
    """
    with open(rank_path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = made(held.value, pattern)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return columns(encoded, "doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def token_digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_documents``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
