"""Token counts of documents in flat token files, found by a separator scan.

A token file is nothing but little-endian token ids, each document followed by the
end-of-document id: no index, no header. Blocks of a file are searched for that id with
one vectorised comparison each. Two prefix scans over the blocks of a file stitch what
crosses their boundaries: a running sum of separators numbers the documents, and a running
maximum of the last separator's place tells where the open document began. The scans run
in groups of ``GROUP`` blocks and then over the groups, so that no task gets all the
blocks of one very large file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns, pieces, saved, shared_dir

#: Bytes of a block; blocks of a group; bytes after which a writer starts a new file.
BLOCK, GROUP, FILE = 4 << 20, 1024, 256 << 20


def write_token_files(docs: DataFrame, rank_path: str, pattern: str, eod: int, dtype: str = "<u2") -> DataFrame:
    """Tokenise ``docs`` into flat token files; the written manifest ``file, n_bytes, ordinal, doc_id``.

    Each attempt of a task writes files of its own name, and the manifest, committed with
    its tasks, names those that count; so lost executors leave no wrong files in use.
    Null counts as empty: a separator alone.
    """
    with open(rank_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    folder = shared_dir(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if eod >= 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError("the separator doesn't fit the type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(held.value, pattern).encode_ordinary
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, at, rows = None, "", 0, []
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.tokens", 0
                    out, rows, ordinal = store.open_output_stream(f"{root}/{name}"), [], 0
                body = np.array([*encode(text or ""), eod], dtype).tobytes()
                out.write(body)
                at += len(body)
                rows.append((ordinal, doc_id))
                ordinal += 1
                if at >= FILE:
                    out.close()
                    out = None
                    yield _manifest(f"{folder}/{name}", at, rows, kind)
        if out is not None:
            out.close()
            yield _manifest(f"{folder}/{name}", at, rows, kind)

    return saved(columns(docs, "doc_id", "text").mapInArrow(run, f"file string, n_bytes long, ordinal long, doc_id {kind}"))


def _manifest(name: str, n_bytes: int, rows: list[tuple], kind: str) -> pa.RecordBatch:
    ids = pa.array([r[1] for r in rows], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows)), pa.array([n_bytes] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), ids],
        ["file", "n_bytes", "ordinal", "doc_id"],
    )


_encoders: dict = {}


def _encoder(rank_file: bytes, pattern: str):
    """A tiktoken encoder, one in each Python worker."""
    import base64

    import tiktoken

    key = (len(rank_file), hash(rank_file), pattern)
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def list_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, n_bytes`` of the files in a folder, without reading them."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))


def scan_blocks(files: DataFrame, eod: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``file, block, n_seps, first, last, size, inner``: what each block has by itself.

    ``first`` and ``last`` are the places of its first and last separators in the file, in
    tokens (null: none), ``size`` its tokens, ``inner`` the lengths between its separators.
    """
    width = np.dtype(dtype).itemsize
    block -= block % width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, tuple] = {}
        for batch in batches:
            for name, size, number in zip(*(batch.column(c).to_pylist() for c in ("file", "n_bytes", "block")), strict=True):
                scheme, _, rest = name.partition(":")
                store, path = pafs.FileSystem.from_uri(f"{scheme}://{rest}" if not rest.startswith("//") else name)
                with store.open_input_file(path) as f:
                    f.seek(number * block)
                    data = np.frombuffer(f.read(min(block, size - number * block)), dtype)
                seps = np.flatnonzero(data == eod)
                base = number * block // width
                first, last = (int(base + seps[0]), int(base + seps[-1])) if len(seps) else (None, None)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]), pa.array([number], pa.int64()), pa.array([len(seps)], pa.int64()), pa.array([first], pa.int64()),
                        pa.array([last], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([np.diff(seps) - 1], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "n_seps", "first", "last", "size", "inner"],
                )
        stores.clear()

    blocks = files.where(F.col("n_bytes") >= width).select(
        "file", (F.col("n_bytes") - F.col("n_bytes") % width).alias("n_bytes"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_bytes - n_bytes % {width} - 1) div {block}"))).alias("block"),
    )
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "file", "block").mapInArrow(
        run, "file string, block long, n_seps long, first long, last long, size long, inner array<long>"
    )


def stitch(blocks: DataFrame) -> DataFrame:
    """``file, ordinal, n_tokens`` of every document: the prefix scans over the blocks.

    Tokens after a file's last separator are a document too; none are none.
    """
    brief = blocks.select("file", "block", "n_seps", "first", "last", "size", F.floor(F.col("block") / GROUP).alias("group"))
    inside = W.partitionBy("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = brief.groupBy("file", "group").agg(F.sum("n_seps").alias("g_seps"), F.max("last").alias("g_last"), F.max("block").alias("g_block"))
    groups = groups.select(
        "file", "group", F.coalesce(F.sum("g_seps").over(across), F.lit(0)).alias("seps_before"), F.max("g_last").over(across).alias("last_before"),
        (F.max("g_block").over(W.partitionBy("file")) == F.col("g_block")).alias("final"), "g_block",
    )
    scanned = brief.withColumns(
        {"seps": F.coalesce(F.sum("n_seps").over(inside), F.lit(0)), "open": F.max("last").over(inside)}
    ).join(groups, ["file", "group"])
    scanned = scanned.select(
        "file", "block", "n_seps", "first", "last",
        (F.col("seps") + F.col("seps_before")).alias("before"),
        F.coalesce("open", "last_before", F.lit(-1)).alias("opened"),
        (F.col("final") & (F.col("block") == F.col("g_block"))).alias("ends"), "size",
    )
    heads = scanned.where("n_seps > 0").select("file", F.col("before").alias("ordinal"), (F.col("first") - F.col("opened") - 1).alias("n_tokens"))
    inner = (
        blocks.where("n_seps > 1").select("file", "block", "inner")
        .join(scanned.select("file", "block", "before"), ["file", "block"])
        .select("file", "before", F.posexplode("inner").alias("i", "n_tokens"))
        .select("file", (F.col("before") + F.col("i") + 1).alias("ordinal"), "n_tokens")
    )
    starts = blocks.groupBy("file").agg(F.sum("size").alias("total"))
    tails = scanned.where("ends").join(starts, "file").select(
        "file", (F.col("before") + F.col("n_seps")).alias("ordinal"),
        (F.col("total") - F.coalesce("last", "opened") - 1).alias("n_tokens"),
    ).where("n_tokens > 0")
    return heads.unionByName(inner).unionByName(tails)


def scan_token_files(files: DataFrame, eod: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``file, ordinal, n_tokens`` for files of ``file, n_bytes``.

    Empty files have no documents; two separators in a row hold an empty one; bytes after
    the last whole id are ignored; repeated files count once.
    """
    return stitch(saved(scan_blocks(columns(files, "file", "n_bytes").dropDuplicates(["file"]), eod, dtype, block)))


def token_counts(docs: DataFrame, rank_path: str, pattern: str, eod: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens``, by writing flat token files and scanning them.

    Null and empty texts have none; very long ones are written and scanned whole, a block at a
    time; repeated rows give repeated results; null ids are kept; an empty table gives none; other
    columns play no part. Files are written and scanned when called.
    """
    manifest = write_token_files(docs, rank_path, pattern, eod, dtype)
    counts = scan_token_files(manifest.groupBy("file").agg(F.max("n_bytes").alias("n_bytes")), eod, dtype, block)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
