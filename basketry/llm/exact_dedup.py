"""Exact dedup by a tree merge of sorted digest runs.

Each input partition writes a run: its rows' digests with their ids, sorted by digest. The
runs are dealt to lanes, a power of two of them, which meet in binomial rounds: in round r a
lane exchanges with the one lane whose number differs in bit r alone, and sends it the part of
its run that belongs on that side, by bit r of the digest's lane. What a lane gets are sorted
runs; it merges them without sorting anew and keeps a row for each digest: the verified winner
and the size of the group so far. After ``log2(lanes)`` rounds each lane owns the digests of its
number. In no round does a lane send more than one row for a digest, so a group with a third of
all rows moves at most one row a lane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, fresh, saved, worth

#: Rows that a lane holds at the end, on average; there are more lanes if there is more data.
RUN_ROWS = 1_000_000
#: A lane for fewer rows costs more in tasks and files than it spares.
LEAST_ROWS = 20_000
_SIZE = 40


def digest_key(text: Column | None = None) -> Column:
    """40 bytes of a text, null counting as empty: its SHA-256, and a second hash of another kind that verifies it."""
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    check = F.lpad(F.hex(F.xxhash64(text, F.length(text))), 16, "0")
    return F.unhex(F.concat(F.sha2(text.cast("binary"), 256), check))


def digest_runs(docs: DataFrame, keep: str = "max") -> DataFrame:
    """Written runs: ``key, doc_id, row_no, lane``, sorted by key, the row to keep last of those with one key.

    ``row_no`` tells repeated rows apart; ``lane`` is the number of the input partition.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    runs = columns(docs, "doc_id", "text").select(
        digest_key().alias("key"), "doc_id", F.monotonically_increasing_id().alias("row_no"), F.spark_partition_id().alias("lane")
    )
    # null ids lose against all others
    order = F.col("doc_id").asc_nulls_first() if keep == "max" else F.col("doc_id").desc_nulls_first()
    return saved(runs.sortWithinPartitions("key", order, "row_no"))


def _keys(run: pa.Table) -> np.ndarray:
    column = run["key"].combine_chunks().cast(pa.binary(_SIZE))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(column.buffers()[1], f"S{_SIZE}", len(column), column.offset * _SIZE)


def _natural_runs(rows: pa.Table, keys: np.ndarray) -> list[pa.Table]:
    """The rows cut where the keys don't rise."""
    cuts = [0, *(np.flatnonzero(keys[1:] <= keys[:-1]) + 1).tolist(), len(keys)]
    return [rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def merge_two(a: pa.Table, b: pa.Table, keep: str) -> pa.Table:
    """Two runs as one, sorted by key; of equal keys the winner stays, with the sum of the sizes.

    The place of each row of the shorter run is looked up in the other one.
    """
    if len(a) < len(b):
        a, b = b, a
    ka, kb = _keys(a), _keys(b)
    at = np.searchsorted(ka, kb)
    same = ka[np.minimum(at, len(ka) - 1)] == kb
    ia, ib = at[same], np.flatnonzero(same)
    both, sizes = pa.concat_tables([a, b]), np.concatenate([x["group_size"].to_numpy() for x in (a, b)])
    from_ = np.arange(len(a))  # where each kept row's id comes from
    if len(ib):
        one, two = a.take(ia), b.take(ib)
        better, tie = (pc.greater if keep == "max" else pc.less)(two["doc_id"], one["doc_id"]), pc.equal(two["doc_id"], one["doc_id"])
        known = pc.and_(pc.is_null(one["doc_id"]), pc.is_valid(two["doc_id"]))
        alike = pc.or_(pc.fill_null(tie, False), pc.and_(pc.is_null(one["doc_id"]), pc.is_null(two["doc_id"])))
        wins = pc.or_(pc.or_(pc.fill_null(better, False), known), pc.and_(alike, pc.greater(two["row_no"], one["row_no"]))).to_numpy(zero_copy_only=False)
        from_[ia[wins]] = len(a) + ib[wins]
        sizes[ia] += sizes[len(a) + ib]
    new = np.flatnonzero(~same)
    place = at[new] + np.arange(len(new))
    order, old = np.empty(len(a) + len(new), np.int64), np.ones(len(a) + len(new), bool)
    old[place] = False
    size = order.copy()
    order[place], order[old] = len(a) + new, from_
    size[place], size[old] = sizes[len(a) + new], sizes[: len(a)]
    out = both.take(order)
    return out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(size))


def merge_all(runs: list[pa.Table], keep: str) -> pa.Table:
    """All runs as one, neighbours first."""
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2], keep) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _folded(rows: pa.Table) -> pa.Table:
    """Sorted rows with a row for each key, the last one, and the number of rows it had."""
    keys = _keys(rows)
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
    return rows.take(last).append_column("group_size", pa.array(np.diff(last, prepend=-1)))


def _exchanged(run: pa.Table, lane: int, bit: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """The run with the lane that each row goes to when lanes that differ in ``bit`` exchange."""
    home = _keys(run).view(np.uint8).reshape(-1, _SIZE)[:, :4].copy().view(">u4").ravel() & np.uint32(lanes - 1)
    to = (home & np.uint32(1 << bit)).astype(np.int32) | np.int32(lane & ~(1 << bit))
    at = run.schema.get_field_index("lane")
    yield from run.set_column(at, "lane", pa.array(to)).to_batches(max_chunksize=50_000)


def merge_runs(runs: DataFrame, keep: str = "max", lanes: int | None = None) -> DataFrame:
    """Written, one row per text: ``key, doc_id, row_no, group_size`` of the row to keep.

    ``runs`` has what ``digest_runs`` writes with the same ``keep``. ``lanes`` is rounded up to a
    power of two; by default there is one for each input partition, up to the session's number of
    shuffle partitions and one for each ``LEAST_ROWS`` rows, or one for each ``RUN_ROWS`` rows if
    that is more. A task holds the run of one lane.
    """
    spark = runs.sparkSession
    if lanes is None:
        seen = runs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("lane") + 1, F.lit(1)).alias("parts")).first()
        most = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // LEAST_ROWS))
        lanes = max(min(seen["parts"], most), -(-seen["n"] // RUN_ROWS), 1)
    rounds = math.ceil(math.log2(lanes))
    lanes = 1 << rounds

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                for lane in pc.unique(batch.column("lane")).to_pylist():  # a batch may have the end of one run and the start of another
                    yield from _exchanged(_folded(rows.filter(pc.equal(rows["lane"], lane))), lane % lanes, 0, lanes)

    def merge(bit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                rows = pa.Table.from_batches(held)
                yield from _exchanged(merge_all(_natural_runs(rows, _keys(rows)), keep), rows["lane"][0].as_py(), bit, lanes)

        return run

    kind = runs.schema["doc_id"].dataType.simpleString()
    schema = f"key binary, doc_id {kind}, row_no long, lane int, group_size long"
    state = runs.select("key", "doc_id", "row_no", "lane").mapInArrow(fold, schema)
    for r in range(max(rounds, 1)):
        state = state.repartitionById(lanes, F.col("lane")).mapInArrow(merge(min(r + 1, 31)), schema)
    return saved(state.drop("lane"))


def exact_dedup(docs: DataFrame, keep: str = "max", lanes: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty; very long ones are compared whole. The
    row with the largest doc_id stays (``keep='min'``: the smallest); of rows equal in id and text
    exactly one stays. Null ids lose. An empty table gives an empty result; other columns play no
    part. Runs are written and merged when called. The result has ``worth(docs)`` partitions at most.
    """
    runs = digest_runs(docs, keep)
    best = merge_runs(runs, keep, lanes).select("key", F.col("doc_id").alias("keep_id"), F.col("row_no").alias("keep_row"), "group_size")
    out = runs.join(best, "key").select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")
    )
    return out.coalesce(worth(docs))


def drop_copies(docs: DataFrame, keep: str = "max", lanes: int | None = None) -> DataFrame:
    """``docs``, whole rows, with one row left of each group of equal texts.

    Which one, and what is equal, as in ``exact_dedup``: null and empty texts are one group, very
    long ones are compared whole, null ids lose, and of rows equal in id and text one stays. Other
    columns, whatever their names, are kept; an empty table gives none. Runs are written and merged
    when called. The result has ``worth(docs)`` partitions at most.
    """
    runs = digest_runs(docs, keep)
    key, best = fresh(docs, "_digest"), fresh(docs, "_best")
    stay = merge_runs(runs, keep, lanes).select(F.col("key").alias(key), F.col("doc_id").alias(best))
    kept = docs.withColumn(key, digest_key()).join(stay, key).where(F.col("doc_id").eqNullSafe(F.col(best)))
    if runs.groupBy("key", "doc_id").count().where("count > 1").limit(1).count() > 0:
        kept = kept.dropDuplicates([key])
    return kept.select(*[F.col(f"`{n}`") for n in docs.columns]).coalesce(worth(docs))
