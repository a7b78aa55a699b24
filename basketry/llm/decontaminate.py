"""Benchmark decontamination over a distributed positional inverted index.

1. Count, over all documents, in how many documents each benchmark term occurs.
2. Every window of a benchmark item gets its anchors: its rarest terms and their offsets.
3. Store the postings (term, document, positions) of all anchor terms as a written table.
4. A window is tried on the documents that have all its anchors; there the offset-adjusted
   posting lists are intersected, rarest first: what is left are starts where all anchors
   stand at their places.
5. Compare the whole window with the words there (exact phrase), and unite what it covers.
   Where all anchors stand close to each other instead, it is a proximity match.
6. Windows that were found lead to the items that have them.

Words of a window that no document has end its search in step 2. Terms of the benchmark
are handled in blocks of ``TERMS_PER_BLOCK``, which bounds what a task holds; of a document a
task holds its postings and the distinct windows tried on it, each once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, forget, fresh, pieces, row_key, saved

#: Words of a window; anchors of a window; words that may come between its own in a proximity match.
WINDOW, ANCHORS, SLOP = 13, 2, 3
#: A task holds at most so many distinct terms at once.
TERMS_PER_BLOCK = 500_000

#: A-Z become a-z; every byte of [\x00-\x2F\x3A-\x60\x7B-\x7F] left separates words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c < 0x80 else c for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text; null has none."""
    return text.translate(_TABLE).split() if text else []


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, window_id, phrase``: the distinct windows of each item.

    A window is ``window`` consecutive words of an item; an item of fewer, but not none,
    is one window. Items without words have none; those without id have windows that hit too.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, digests, phrases = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), _texts(batch), strict=True):
                if not (words := words_of(text)):
                    continue
                for phrase in {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}:
                    ids.append(item)
                    digests.append(hashlib.sha256(phrase).digest()[:16])
                    phrases.append(phrase)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(digests, pa.binary()), pa.array(phrases, pa.binary())],
                ["item_id", "window_id", "phrase"],
            )

    items = columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(cut, "item_id string, window_id binary, phrase binary")


def distinct_windows(windows: DataFrame) -> DataFrame:
    """``window_id, phrase``: each window once, however many items share it."""
    return windows.groupBy("window_id").agg(F.first("phrase").alias("phrase"))


def _blocks(terms: DataFrame, limit: int) -> Iterator[frozenset[bytes]]:
    """The distinct terms (a column ``term``) in blocks of at most ``limit``."""
    n = terms.count()
    parts = max(1, -(-n // max(1, limit // 2)))  # half full on average, so that no block runs over
    for p in range(parts):
        block = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == p) if parts > 1 else terms
        yield frozenset(bytes(r[0]) for r in block.collect())


def document_frequencies(docs: DataFrame, terms: DataFrame, limit: int = TERMS_PER_BLOCK) -> DataFrame:
    """``term, df``: in how many rows of ``docs`` each of ``terms`` occurs (none: no row)."""
    spark, out = docs.sparkSession, None
    for block in _blocks(terms, limit):
        held = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, n = held.value, Counter()
            for batch in pieces(batches):
                for text in _texts(batch):
                    n.update(known.intersection(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["term", "df"])

        part = columns(docs, "text").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        out = part if out is None else out.unionAll(part)
    return out


def build_index(docs: DataFrame, terms: DataFrame, limit: int = TERMS_PER_BLOCK) -> DataFrame:
    """The written index: ``key, doc_id, n_words, term, positions``.

    A row for each document and each of ``terms`` in it, with all its positions; and one
    with a null term for each document, also for those with no words.
    """
    spark, out = docs.sparkSession, None
    source = docs.select("doc_id", "text", row_key().alias("key"))
    for i, block in enumerate(_blocks(terms, limit)):
        held = spark.sparkContext.broadcast(block)

        def post(batches: Iterator[pa.RecordBatch], held=held, first=i == 0) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in pieces(batches):
                rows, counts, names, places = [], [], [], []
                for row, text in enumerate(_texts(batch)):
                    words = words_of(text)
                    if first:
                        rows.append(row)
                        counts.append(len(words))
                        names.append(None)
                        places.append(None)
                    found: dict[bytes, list[int]] = {}
                    for at, word in enumerate(words):
                        if word in known:
                            found.setdefault(word, []).append(at)
                    for word, at in found.items():
                        rows.append(row)
                        counts.append(len(words))
                        names.append(word)
                        places.append(at)
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(take), batch.column("doc_id").take(take), pa.array(counts, pa.int64()),
                        pa.array(names, pa.binary()), pa.array(places, pa.list_(pa.int32())),
                    ],
                    ["key", "doc_id", "n_words", "term", "positions"],
                )

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = source.mapInArrow(post, f"key binary, doc_id {kind}, n_words long, term binary, positions array<int>")
        out = part if out is None else out.unionAll(part)
    return saved(out)


def window_terms(windows: DataFrame) -> DataFrame:
    """``window_id, term, offset``: every word of every window."""
    return windows.select(
        "window_id", F.posexplode(F.split(F.col("phrase").cast("string"), " ")).alias("offset", "term")
    ).select("window_id", F.col("term").cast("binary").alias("term"), "offset")


def anchors_of(windows: DataFrame, frequencies: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """``window_id, term, offset, rank, needed``: the rarest distinct terms, at their first offsets.

    Windows with a term that no document has are left out: they occur nowhere.
    """
    each = window_terms(windows).groupBy("window_id", "term").agg(F.min("offset").alias("offset"))
    known = each.join(frequencies, "term", "left")
    # a window has few words, so its list is short whatever the input
    lists = known.groupBy("window_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "offset"))).alias("terms")
    )
    lists = lists.where(F.col("terms")[0]["df"] > 0).select("window_id", F.slice("terms", 1, anchors).alias("terms"))
    return lists.select("window_id", F.size("terms").alias("needed"), F.posexplode("terms").alias("rank", "t")).select(
        "window_id", F.col("t.term").alias("term"), F.col("t.offset").alias("offset"), "rank", "needed"
    )


def windows_to_try(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """``key, window_id``: the documents that have all anchors of a window, whatever their places.

    Repeated rows share a key and repeat its postings, so distinct anchors are counted.
    """
    lists = index.where("term is not null").select("key", "term")
    some = lists.join(anchors, "term").groupBy("key", "window_id").agg(F.countDistinct("rank").alias("n"), F.first("needed").alias("needed"))
    return some.where("n = needed").select("key", "window_id")


def _starts(lists: list[np.ndarray], offsets: list[int]) -> np.ndarray:
    """Where all terms stand at their offsets, by intersecting from the rarest on."""
    found = lists[0] - offsets[0]
    for places, offset in zip(lists[1:], offsets[1:], strict=True):
        if not len(found):
            break
        found = np.intersect1d(found, places - offset, assume_unique=True)
    return found[found >= 0]


def _close(lists: list[np.ndarray], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first term that have every other one within ``reach`` words, and how far the farthest is."""
    rare, far = lists[0], np.zeros(len(lists[0]), np.int64)
    for places in lists[1:]:
        after = np.searchsorted(places, rare)
        gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - rare), np.abs(places[np.maximum(after - 1, 0)] - rare))
        far = np.maximum(far, gap)
    near = far < reach
    return rare[near], far[near]


def phrase_matches(docs: DataFrame, index: DataFrame, anchors: DataFrame, windows: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document with a match of either kind: ``key, n_hit, starts, found, near``.

    ``windows`` has distinct windows. ``starts`` has the places of exact matches as
    ``start:length`` and ``found`` the ids of their windows. ``near`` has (start, span) of
    proximity matches: the places of a window's rarest anchor that have its other ones, in any
    order, within ``window + slop`` words, and the least distance of the farthest of those.
    """
    tries = saved(windows_to_try(index, anchors))
    terms = anchors.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term", "offset"))).alias("anchors"))
    # a document's windows, each once, and its postings of their terms, each once
    per = tries.join(windows.join(terms, "window_id"), "window_id").groupBy("key").agg(F.collect_list(F.struct("window_id", "phrase", "anchors")).alias("tried"))
    postings = index.where("term is not null").select("key", "term", "positions").join(tries.select("key").distinct(), "key", "left_semi")
    postings = postings.groupBy("key").agg(F.collect_list(F.struct("term", "positions")).alias("postings"))
    texts = columns(docs, "doc_id", "text").select("text", row_key().alias("key")).where("text is not null")
    joined = texts.join(per.join(postings, "key"), "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for key, text, tried, postings in zip(batch.column("key").to_pylist(), _texts(batch), batch.column("tried").to_pylist(), batch.column("postings").to_pylist(), strict=True):
                words, places = words_of(text), {p["term"]: np.array(p["positions"], np.int64) for p in postings}
                spans, windows_found, near = set(), [], {}
                for w in tried:
                    phrase, lists = w["phrase"].split(), [places[a["term"]] for a in w["anchors"]]
                    exact = [(s, len(phrase)) for s in _starts(lists, [a["offset"] for a in w["anchors"]]).tolist() if words[s : s + len(phrase)] == phrase]
                    if exact:
                        spans.update(exact)
                        windows_found.append(w["window_id"])
                    for at, span in zip(*(x.tolist() for x in _close(lists, window + slop)), strict=True):
                        near[at] = min(span, near.get(at, span))
                if spans or near:
                    covered, end = 0, 0
                    for at, size in sorted(spans):
                        covered += max(0, at + size - max(at, end))
                        end = max(end, at + size)
                    rows.append((key, covered, [f"{a}:{n}" for a, n in sorted(spans)], windows_found, [{"start": a, "span": n} for a, n in sorted(near.items())]))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.struct([("start", pa.int64()), ("span", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "n_hit", "starts", "found", "near"])

    out = joined.mapInArrow(verify, "key binary, n_hit long, starts array<string>, found array<binary>, near array<struct<start: long, span: long>>")
    out = saved(out.dropDuplicates(["key"]))  # rows equal in id and text are one document
    forget(tries)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS, slop: int = SLOP, limit: int = TERMS_PER_BLOCK
) -> DataFrame:
    """Per row of ``docs``: ``key, doc_id, n_words, n_hit, starts, items, near, contaminated``.

    A word inside any occurrence of a window is hit; a document is contaminated if it has
    hits and they make at least a twentieth of its words. ``items`` are the ids of the items
    whose windows occur, sorted as strings; an item without id hits, but has no name to list.
    ``near`` has proximity matches, which contaminate nothing. Null and empty texts have no words;
    very long ones are read whole; null ids are kept; repeated rows give repeated results; an
    empty table gives none, and an empty benchmark hits nothing. Other columns play no part.
    Tables are written when called.
    """
    cuts = saved(item_windows(benchmark, window))
    windows = saved(distinct_windows(cuts))
    vocabulary = window_terms(windows).select("term").distinct()
    frequencies = saved(document_frequencies(docs, vocabulary, limit))
    chosen = saved(anchors_of(windows, frequencies, anchors))
    index = build_index(docs, chosen.select("term").distinct(), limit)
    hits = phrase_matches(docs, index, chosen, windows, window, slop)
    forget(windows, frequencies, chosen)
    named = cuts.where("item_id is not null").select("window_id", "item_id")
    items = hits.select("key", F.explode("found").alias("window_id")).join(named, "window_id").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return index.where("term is null").select("key", "doc_id", "n_words").join(hits.drop("found"), "key", "left").join(items, "key", "left").select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), "starts",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("near", F.array().cast("array<struct<start: long, span: long>>")).alias("near"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs``, whole rows, without the contaminated ones.

    Null and empty texts have no words and stay; very long ones are read whole; rows that repeat
    all stay or go; null ids and other columns, whatever their names, are kept; an empty table
    gives none, and with an empty benchmark all stay. Tables are written when called.
    """
    key = fresh(docs, "_key")
    bad = decontaminate(docs, benchmark, **options).where("contaminated").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
