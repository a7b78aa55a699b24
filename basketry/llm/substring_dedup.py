"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``WINDOW`` consecutive words. In every window the ``GRAM``-word gram with the
smallest hash is its anchor; equal windows have equal anchors, wherever they stand. The words
from an anchor to the end of the next one are a link; a document is a chain of links.

1. Index: the anchors of all documents, each with the hash of its link. Every block of every
   document is indexed; an anchor has a reference block for each link that follows it
   anywhere, that of the smallest document.
2. Parse: a document is factored greedily against the reference blocks. A factor starts at an
   anchor whose link a smaller document has, and runs on from link to link as long as the next
   one has its reference in the same document, right behind. All windows inside a factor start
   in a smaller document.
3. Factor boundaries: a window that holds a shared anchor but lies in no factor (it
   crosses a boundary, or was changed near it) is looked up by a 96-bit hash among all such
   windows; the smallest document with it decides. The first document with a window never has
   it inside a factor, so what is looked up is complete.

What windows share no anchor with another document leaves in step 1. Long copies thus cost
an entry for every twenty words or so, not one for each window. Words are compared by hashes of
64 bits for an anchor and 64 for its link, and of 96 for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, columns, forget, pieces, release, row_key, saved

WINDOW, GRAM = 50, 10
#: Distinct words whose hashes a task remembers before it forgets all of them.
REMEMBERED = 500_000
# Two odd multipliers of the rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Rolling:
    """Hashes of ranges of words that don't depend on where the range stands."""

    def __init__(self):
        self.words, self.powers = _Hashes(), []
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.powers = []
        with np.errstate(over="ignore"):
            for base in _BASES:
                back = pow(base, -1, 1 << 64)
                self.powers.append(tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64)))) for b in (base, back)))

    def prefixes(self, words: list[bytes], which: int) -> np.ndarray:
        n = len(words)
        if n >= len(self.powers[0][0]):
            self._grow(2 * n)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        if which:
            h = _mix(h)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(h * self.powers[which][0][:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        return _mix((prefix[ends] - prefix[starts]) * self.powers[which][1][starts])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the smallest of ``g[i : i + width]``."""
    best, size = np.arange(len(g)), 1
    pick = lambda a, b: np.where(g[a] <= g[b], a, b)
    while 2 * size <= width:
        best = pick(best[: len(best) - size], best[size:])
        size *= 2
    return pick(best[: len(g) - width + 1], best[width - size :][: len(g) - width + 1])


class Parser:
    """The anchors and windows of documents, a piece at a time."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram, self.rolling = window, gram, Rolling()

    def read(self, lists: list[list[bytes]]):
        """Anchors of each document: (places, hashes, links); and by window, its anchor."""
        words = [w for x in lists for w in x]
        ends = np.cumsum([len(x) for x in lists])
        self.first = self.rolling.prefixes(words, 0)
        out, k, start = [], self.gram, 0
        n = len(words)
        if n >= self.window:
            at = np.arange(n - k + 1)
            g = self.rolling.ranges(self.first, at, at + k, 0)
            holds = _smallest(g, self.window - k + 1)  # by start of window
        for end in ends.tolist():
            if end - start < self.window:
                none = np.empty(0, np.int64)
                out.append((none, none.astype(np.uint64), none.astype(np.uint64), none))
            else:
                mine = holds[start : end - self.window + 1]
                places = mine[np.concatenate(([True], mine[1:] != mine[:-1]))]
                links = np.zeros(len(places), np.uint64)
                links[:-1] = self.rolling.ranges(self.first, places[:-1], places[1:] + k, 0) | np.uint64(1)
                out.append((places - start, g[places], links, mine - start))
            start = end
        return words, out


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    """Words are [^\\x20\\x09-\\x0D]+, unchanged; null has none."""
    return [x.split() if x else [] for x in as_bytes(batch)]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)).cast(kind))


def index_anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The written index: ``key, doc_id, n_words, sha256, hashes, places, links`` a document.

    ``links`` has the hash of the words from an anchor to the end of the next one, 0 for the last.
    Rows without id have no anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, gram)
        for batch in pieces(batches):
            lists = _words(batch)
            _, found = parser.read(lists)
            known = batch.column("doc_id").is_valid().to_pylist()
            found = [x if ok else tuple(a[:0] for a in x) for x, ok in zip(found, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in lists]),
                    _lists([x[1].view(np.int64) for x in found], pa.int64()), _lists([x[0] for x in found], pa.int32()),
                    _lists([x[2].view(np.int64) for x in found], pa.int64()),
                ],
                ["key", "doc_id", "n_words", "sha256", "hashes", "places", "links"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(
        run, f"key binary, doc_id {kind}, n_words long, sha256 string, hashes array<long>, places array<int>, links array<long>"
    )
    return saved(rows)


def shared_anchors(index: DataFrame) -> DataFrame:
    """Written, per document: ``key, shared``: its anchors that other documents have too.

    Each with the reference block of its link: (place, doc, place there); the document itself
    where no other one has the link.
    """
    each = index.select("key", "doc_id", F.explode(F.arrays_zip("hashes", "places", "links")).alias("a")).select(
        "key", "doc_id", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"), F.col("a.links").alias("link")
    )
    ends = each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # written, so that both sides of the joins are dealt anew and a common anchor or link can be split
    common = saved(ends.where("first < last").select("hash"))
    found = saved(each.join(common, "hash"))
    blocks = saved(found.where("link <> 0").groupBy("hash", "link").agg(F.min(F.struct("doc_id", "place")).alias("block")))
    known = found.join(blocks, ["hash", "link"], "left").select(
        "key", F.struct("place", F.coalesce("block.doc_id", "doc_id").alias("doc"), F.coalesce("block.place", "place").alias("there")).alias("s")
    )
    out = saved(known.groupBy("key").agg(F.collect_list("s").alias("shared")))
    forget(common, found, blocks)
    return out


def parse(docs: DataFrame, shared: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Written, per document with shared anchors: ``no, key, doc_id, factors, high, low, starts``.

    ``factors`` are (start, end) of factors of a window at least; ``high, low, starts`` the
    hashes and places of the windows at their boundaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, gram)
        for batch in pieces(batches):
            lists = _words(batch)
            words, found = parser.read(lists)
            second = parser.rolling.prefixes(words, 1)
            column = batch.column("shared")
            inner = column.flatten()
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            fields = {c: inner.field(c).to_numpy(zero_copy_only=False) for c in ("place", "doc", "there")}
            factors, high, low, starts, base = [], [], [], [], 0
            for row, (doc_id, mine) in enumerate(zip(batch.column("doc_id").to_pylist(), found, strict=True)):
                places, by_window = mine[0], mine[3]
                part = {c: v[offsets[row] : offsets[row + 1]] for c, v in fields.items()}
                order = np.unique(part["place"], return_index=True)[1]  # repeated rows come twice
                part = {c: v[order] for c, v in part.items()}
                spans = _factors(doc_id, part, places, window, gram)
                n = len(by_window)
                held = np.zeros(len(lists[row]) + 1, bool)
                held[part["place"]] = True
                look = held[by_window] if n else np.empty(0, bool)
                for s, e in spans:
                    look[s : max(s, e - window + 1)] = False
                at = np.flatnonzero(look)
                high.append(parser.rolling.ranges(parser.first, at + base, at + base + window, 0).view(np.int64))
                low.append((parser.rolling.ranges(second, at + base, at + base + window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                starts.append(at.astype(np.int32))
                factors.append([{"start": s, "end": e} for s, e in spans])
                base += len(lists[row])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc_id"), pa.array(factors, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    _lists(high, pa.int64()), _lists(low, pa.int32()), _lists(starts, pa.int32()),
                ],
                ["key", "doc_id", "factors", "high", "low", "starts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text", row_key().alias("key")).where("text is not null")
    rows = texts.join(shared, "key").mapInArrow(
        run, f"key binary, doc_id {kind}, factors array<struct<start: long, end: long>>, high array<long>, low array<int>, starts array<int>"
    )
    return saved(rows.select(F.monotonically_increasing_id().alias("no"), "*"))


def _factors(doc_id, part: dict, places: np.ndarray, window: int, gram: int) -> list[tuple[int, int]]:
    """Greedy factors, as spans of a window at least; ``part`` has the shared anchors, sorted by place."""
    place, doc, there = part["place"], part["doc"], part["there"]
    if not len(place):
        return []
    rank, smaller = np.searchsorted(places, place), doc < doc_id  # the last anchor has no link and no smaller reference
    on = smaller[:-1] & smaller[1:] & (rank[1:] == rank[:-1] + 1) & (doc[1:] == doc[:-1]) & (there[1:] - there[:-1] == place[1:] - place[:-1])
    edges = np.flatnonzero(np.concatenate(([True], ~on, [True])))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if smaller[a]:
            s, e = int(place[a]), int(places[rank[b - 1] + 1]) + gram
            if e - s >= window:
                out.append((s, e))
    return out


def boundary_windows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``no, dup``: the looked-up windows of each document that a smaller one has; and the written table that this reads."""
    each = parsed.select("no", "doc_id", F.explode(F.arrays_zip("high", "low", "starts")).alias("w")).select(
        "no", "doc_id", F.col("w.high").alias("high"), F.col("w.low").alias("low"), F.col("w.starts").alias("start")
    )
    first = each.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    # written, so that both sides of the join are dealt anew and a common window can be split
    first = saved(first)
    release(parsed.sparkSession)
    found = each.join(first, ["high", "low"]).where("first < doc_id")
    return found.groupBy("no").agg(F.collect_list("start").alias("dup")), first


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The index, and ``key, spans, in_factors`` of the documents with spans.

    ``spans`` are sorted (start, end) in words, which may overlap; ``in_factors`` counts the words in factors.
    """
    index = index_anchors(docs, window, gram)
    shared = shared_anchors(index)
    release(docs.sparkSession)
    parsed = parse(docs, shared, window, gram)
    forget(shared)
    release(docs.sparkSession)
    windows, owners = boundary_windows(parsed)
    both = parsed.select("no", "key", "factors").join(windows, "no", "left")
    ranges = F.concat("factors", F.coalesce(F.transform("dup", lambda s: F.struct(s.cast("long").alias("start"), (s + window).cast("long").alias("end"))), F.array()))
    spans = both.where(F.size(ranges) > 0).select("key", F.array_sort(ranges).alias("spans"), covered("factors").alias("in_factors")).dropDuplicates(["key"])
    spans = saved(spans)
    forget(parsed, owners)
    release(docs.sparkSession)
    return index, spans


def covered(spans: str) -> Column:
    """The words in sorted spans, each once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end"))
    return F.aggregate(spans, start, add)["n"]


def repeated(index: DataFrame) -> bool:
    """Whether rows equal in id and text occur."""
    return index.groupBy("key").count().where("count > 1").limit(1).count() > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``key, doc_id, n_words, n_removed, in_factors, spans, kept, kept_sha256``.

    A word goes if a window that covers it also starts in a document with a smaller id;
    windows are judged on the input. ``in_factors`` counts the words that factors alone cover.
    ``kept`` is the text left, its words joined by one space; null if nothing was removed. Null and
    empty texts have no words; texts shorter than a window lose nothing; very long ones are parsed
    whole; rows without id neither lose nor cause anything; rows equal in id and text get equal
    results; an empty table gives none; other columns play no part. Tables are written when called.
    """
    index, spans = duplicate_spans(docs, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            gone, kept = [], []
            for words, found in zip(_words(batch), batch.column("spans").to_pylist(), strict=True):
                left, at, removed = [], 0, 0
                for span in found:
                    s, e = max(span["start"], at), span["end"]
                    if e > s:
                        left += words[at:s]
                        removed += e - s
                        at = e
                left += words[at:]
                gone.append(removed)
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("in_factors"), batch.column("spans"), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                ],
                ["key", "in_factors", "spans", "n_removed", "kept", "kept_sha256"],
            )

    texts = columns(docs, "doc_id", "text").select("text", row_key().alias("key")).where("text is not null")
    # rows equal in id and text come once
    cut = texts.join(spans, "key")
    if repeated(index):
        cut = cut.groupBy("key").agg(*[F.first(c).alias(c) for c in ("text", "spans", "in_factors")])
    cut = cut.mapInArrow(run, "key binary, in_factors long, spans array<struct<start: long, end: long>>, n_removed long, kept string, kept_sha256 string")
    return index.select("key", "doc_id", "n_words", "sha256").join(cut, "key", "left").select(
        "key", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("in_factors", F.lit(0)).cast("long").alias("in_factors"), "spans", "kept",
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
