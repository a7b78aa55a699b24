"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each distinct set of five-word shingles has ``TREES`` signatures of ``LONGEST`` levels, one
MinHash value (16 bits of it) a level: a leaf in each of as many prefix tries. Two sets of
similarity s share the first k levels of a trie with probability s^k, so that a share of
``1 - (1 - s^k)^TREES`` of such pairs meets in a node of depth k.

Matching begins at the longest prefixes. All pairs below the trie nodes of a depth are
candidates, and the whole shingle sets decide. The links found tell how similar links are in
these data, and with that how many must have been missed: each stands for one over its chance
of being found. While the share found misses ``RECALL``, prefixes are shortened to the depth at
which that mixture of similarities reaches it. One unseen link at the least similarity is always
assumed, so that few links prove nothing.

Trie nodes with few sets below them give pairs of ids. Nodes with many are cut into chunks;
each pair of chunks is a task of its own that compares the sets of both with matrix
products and gives back, for each set, the number of its links and the component it is in,
never the pairs. A pair below several large nodes counts in the one with the smallest key.
Chunks hold a bounded number of sets and, on average, of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, columns, forget, fresh, pieces, release, row_key, saved
from .decontaminate import words_of
from .substring_dedup import Rolling, repeated

WORDS, SIMILARITY = 5, (4, 5)
TREES, LONGEST, RECALL = 24, 8, 0.99999
#: Sets below a trie node up to which their pairs are listed; sets, and shingles on average, of a chunk above that.
FEW, CHUNK, CHUNK_SHINGLES = 16, 256, 1 << 21
#: Bytes of text that a task shingles at a time, but for a longer text.
PIECE = 1 << 20
#: Bytes of a level in a signature; similarities are counted in so many steps.
LEVEL, STEPS = 2, 100


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """The share of pairs of that similarity that meet in some trie's node of that depth."""
    return 1 - (1 - similarity**depth) ** trees


def recall_at(depth: int, links: dict[int, float], trees: int = TREES) -> float:
    """The share of links that meet at ``depth``; ``links`` has how many there are of each similarity, in ``STEPS``."""
    total = sum(links.values())
    return sum(n * found_share(s / STEPS, depth, trees) for s, n in links.items()) / total


def next_depth(depth: int, seen: dict[int, int], recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix, of ``depth`` levels at most, at which the links that ``seen`` ones at ``depth`` stand for are found.

    ``seen`` has numbers of links by similarity, in ``STEPS`` rounded down.
    """
    least = SIMILARITY[0] * STEPS // SIMILARITY[1]
    links = {s: n / found_share(s / STEPS, depth, trees) for s, n in seen.items()}
    links[least] = links.get(least, 0.0) + 1.0
    return next((d for d in range(depth, 1, -1) if recall_at(d, links, trees) >= recall), 1)


def least_depth(recall: float = RECALL, trees: int = TREES, longest: int = LONGEST) -> int:
    """The depth at which links of the least similarity are found: prefixes are never shorter."""
    return next_depth(longest, {SIMILARITY[0] * STEPS // SIMILARITY[1]: 1 << 40}, recall, trees)


class Shingler:
    """Sets of hashed shingles, and their signatures, a piece at a time."""

    def __init__(self, words: int, trees: int, levels: int):
        self.words, self.trees, self.levels, self.rolling = words, trees, levels, Rolling()
        draw = np.random.default_rng(5)
        self.factors = draw.integers(0, 1 << 31, trees * levels, np.uint32) * np.uint32(2) + np.uint32(1)
        self.flips = draw.integers(0, 1 << 32, trees * levels, np.uint32)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; a text of fewer words, but not none, is one."""
        lists = [words_of(x) for x in texts]
        flat = [w for x in lists for w in x]
        prefix, at, out = self.rolling.prefixes(flat, 0), 0, []
        n = len(flat) - self.words + 1
        starts = np.arange(max(n, 0))
        grams = self.rolling.ranges(prefix, starts, starts + self.words, 0)
        for x in lists:
            if len(x) >= self.words:
                out.append(np.unique(grams[at : at + len(x) - self.words + 1]))
            elif x:
                out.append(self.rolling.ranges(prefix, np.array([at]), np.array([at + len(x)]), 0) + np.uint64(len(x)))
            else:
                out.append(np.empty(0, np.uint64))
            at += len(x)
        return out

    def signatures(self, sets: list[np.ndarray]) -> list[bytes]:
        """For each set (none empty) its leaves: for each trie, ``LEVEL`` bytes of a MinHash value a level."""
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        out, mixed = np.empty((len(sets), self.trees * self.levels), "<u2"), np.empty_like(flat)
        for i in range(self.trees * self.levels):
            np.bitwise_xor(flat, self.flips[i], out=mixed)
            np.multiply(mixed, self.factors[i], out=mixed)
            least = np.minimum.reduceat(mixed, offsets)
            out[:, i] = (least ^ (least >> np.uint32(16))).astype("<u2")
        return [row.tobytes() for row in out]


def sign(docs: DataFrame, words: int = WORDS, trees: int = TREES, levels: int = LONGEST) -> DataFrame:
    """Written, per row: ``key, doc_id, n_shingles, set_id, leaves``; ``leaves`` is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, trees, levels)
        for batch in pieces(batches, most=PIECE):
            sets = shingler.sets(as_bytes(batch))
            some = [s for s in sets if len(s)]
            found = iter(shingler.signatures(some) if some else ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.binary()),
                ],
                ["key", "doc_id", "n_shingles", "set_id", "leaves"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.select("doc_id", "text", row_key().alias("key")).mapInArrow(run, f"key binary, doc_id {kind}, n_shingles long, set_id binary, leaves binary"))


def distinct_sets(signed: DataFrame) -> DataFrame:
    """Written, per distinct set with shingles: ``node, set_id, rep, rep_key, n_copies, n_shingles, leaves``.

    ``rep`` is its smallest doc_id (null only if no copy has one).
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n_shingles", "leaves")).alias("m")
    sets = signed.where("n_shingles > 0").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("n_copies"))
    return saved(
        sets.select(
            F.monotonically_increasing_id().alias("node"), "set_id", F.col("m.doc_id").alias("rep"), F.col("m.key").alias("rep_key"), "n_copies",
            F.col("m.n_shingles").alias("n_shingles"), F.col("m.leaves").alias("leaves"),
        )
    )


def trie_nodes(sets: DataFrame, depth: int, trees: int = TREES, levels: int = LONGEST) -> DataFrame:
    """Written ``node, key, n_shingles, size, weight``: the trie nodes of ``depth`` above each set that have others below them too."""
    prefix = F.expr(f"substring(leaves, tree * {levels * LEVEL} + 1, {depth * LEVEL})")
    each = sets.select("node", "n_shingles", "leaves", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", "n_shingles", F.xxhash64("tree", prefix).alias("key"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")).where("size > 1")
    return saved(each.join(sizes, "key"))


def candidates(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b``: pairs below small trie nodes; and, written, ``node, hot``: the large ones above each set.

    A pair that has a large trie node in common isn't listed.
    """
    few = members.where(F.col("size") <= FEW).select("key", "node")
    hot = saved(members.where(F.col("size") > FEW).groupBy("node").agg(F.collect_list(F.struct("key", "size", "weight")).alias("hot")))
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b").distinct()
    return apart(pairs, hot), hot


def apart(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b and others) without a large trie node in common."""
    keys = hot.select("node", F.col("hot.key").alias("keys"))
    both = pairs.join(keys.toDF("a", "keys_a"), "a", "left").join(keys.toDF("b", "keys_b"), "b", "left")
    return both.where(~F.coalesce(F.arrays_overlap("keys_a", "keys_b"), F.lit(False))).select(*pairs.columns)


def _linked(n_a: np.ndarray | int, n_b: np.ndarray | int, both: np.ndarray | int):
    """Whether the Jaccard similarity reaches SIMILARITY, in whole numbers."""
    return both * SIMILARITY[1] >= (n_a + n_b - both) * SIMILARITY[0]


def _step(n_a: np.ndarray | int, n_b: np.ndarray | int, both: np.ndarray | int):
    """The Jaccard similarity in ``STEPS``, rounded down."""
    return both * STEPS // (n_a + n_b - both)


def verify_pairs(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``a, b, step``: the pairs whose shingle sets are similar enough, and their similarity in ``STEPS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, 1, 1)
        for batch in pieces(batches, "text_a", PIECE):
            one, two = shingler.sets(as_bytes(batch, "text_a")), shingler.sets(as_bytes(batch, "text_b"))
            sizes = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(one, two, strict=True)]
            out = batch.select(["a", "b"]).append_column("step", pa.array([_step(*x) for x in sizes], pa.int32()))
            yield out.filter(pa.array([bool(_linked(*x)) for x in sizes], pa.bool_()))

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, step int")


def verify_chunks(hot: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``node, n, root, steps``: per set and pair of chunks, its links there and its component's first set.

    ``steps`` has, in one row of each pair of chunks, how many links have which similarity.
    """

    def run(group: pa.Table) -> pa.Table:
        key, i, j = (group[c][0].as_py() for c in ("key", "i", "j"))
        nodes = group["node"].to_numpy()
        sets = Shingler(words, 1, 1).sets(group["text"].cast(pa.binary()).to_pylist())
        sizes = np.array([len(s) for s in sets])
        both = _overlaps(sets)
        link = _linked(sizes[:, None], sizes[None, :], both)
        np.fill_diagonal(link, False)
        side = group["chunk"].to_numpy()
        if i != j:
            link &= side[:, None] != side[None, :]
        above: dict[int, list[int]] = {}
        for row, keys in enumerate(group["keys"].to_pylist()):
            for k in keys:
                if k < key:
                    above.setdefault(k, []).append(row)
        for rows in above.values():  # these pairs count elsewhere
            if len(rows) > 1:
                link[np.ix_(rows, rows)] = False
        one, two = np.nonzero(np.triu(link))
        steps = np.bincount(_step(sizes[one], sizes[two], both[one, two]), minlength=STEPS + 1).tolist()
        counts = pa.array([steps] + [None] * (len(nodes) - 1), pa.list_(pa.int64()))
        return pa.table([pa.array(nodes), pa.array(link.sum(axis=1).astype(np.int64)), pa.array(nodes[_components(link)]), counts], ["node", "n", "root", "steps"])

    each = hot.select("node", F.col("hot.key").alias("keys"), F.explode("hot").alias("h")).select("node", "keys", "h.key", "h.size", "h.weight")
    each = each.withColumn("chunks", F.greatest(F.ceil(F.col("size") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int"))
    each = each.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = each.select("node", "keys", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = cells.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other")
    rows = cells.join(texts, "node").select("node", "keys", "key", "chunk", "i", "j", "text")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "node long, n long, root long, steps array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, by products of 0/1 matrices a slice of columns at a time."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    used = shared[column]
    row, column = row[used], number[column[used]]
    out = np.diag([len(s) for s in sets]).astype(np.int64)
    off = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, width = int(shared.sum()), 8192
    for start in range(0, total, width):
        a, b = np.searchsorted(column, (start, start + width))
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        off += part @ part.T
    off = np.rint(off).astype(np.int64)
    np.fill_diagonal(off, 0)
    return out + off


def _components(link: np.ndarray) -> np.ndarray:
    """For each row the first row of its component."""
    m = len(link)
    root = np.full(m, -1)
    for first in range(m):
        if root[first] >= 0:
            continue
        reach = np.zeros(m, bool)
        reach[first] = True
        edge = reach.copy()
        while edge.any():
            edge = link[edge].any(axis=0) & ~reach
            reach |= edge
        root[reach] = first
    return root


def components(edges: DataFrame) -> DataFrame:
    """Written ``node, label`` for edges ``u, v``: the smallest node of each one's component.

    Labels spread to neighbours and then jump to the label of their label, so that rounds
    grow with the logarithm of a component's width; each round is written.
    """
    both = saved(edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        ahead = spread.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = saved(spread.join(ahead, "next").select("node", F.least("next", "far").alias("next"), "label"))
        more = moved.where("next <> label").limit(1).count() > 0
        forget(written)
        written, labels = moved, moved.select("node", F.col("next").alias("label"))
        if not more:
            forget(both)
            return labels


def _seen(linked: DataFrame, cells: DataFrame) -> dict[int, int]:
    """How many links there are of each similarity: ``STEPS`` numbers at most."""
    of_cells = cells.where("steps is not null").select(F.posexplode("steps").alias("step", "n")).where("n > 0")
    both = linked.select("step", F.lit(1).cast("long").alias("n")).unionByName(of_cells)
    return {r["step"]: r["n"] for r in both.groupBy("step").agg(F.sum("n").alias("n")).collect()}


def forest_links(sets: DataFrame, texts, recall: float = RECALL, words: int = WORDS, trees: int = TREES, levels: int = LONGEST) -> tuple[DataFrame, DataFrame, int]:
    """``a, b`` of links below small trie nodes, ``node, n, root`` of those below large ones, and the depth at which matching ended.

    ``texts`` is called with the nodes that any depth can match and gives ``node, text`` of them.
    """
    spark, least, depth = sets.sparkSession, least_depth(recall, trees, levels), levels
    shallow = trie_nodes(sets, least, trees, levels)
    some = shallow.select("node").distinct()
    texts, sets = texts(some), saved(sets.join(some, "node"))
    tried = linked = None
    done: list[DataFrame] = [texts, sets, shallow]
    while True:
        members = shallow if depth == least else trie_nodes(sets, depth, trees, levels)
        pairs, hot = candidates(members)
        pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        done += [members, pairs, hot]
        release(spark)
        found = saved(verify_pairs(pairs, texts, words))
        cells = saved(verify_chunks(hot, texts, words))
        release(spark)
        # links that now have a large node in common count there
        if linked is not None:
            done += [linked, found]
            found = saved(apart(linked, hot).unionByName(found))
        linked = found
        shorter = max(least, next_depth(depth, _seen(linked, cells), recall, trees))
        if shorter >= depth:
            forget(*done)
            return linked, cells, depth
        done.append(cells)
        depth, tried = shorter, pairs if tried is None else tried.unionByName(pairs)


def near_duplicates(docs: DataFrame, words: int = WORDS, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: ``key, doc_id, class_id, n_links, n_copies, n_shingles, first``.

    Two texts are linked if the Jaccard similarity of their sets of five lower-cased words
    in a row is 0.8 or more; texts with equal sets are copies. ``class_id`` is the smallest
    doc_id that links and copies lead to, ``n_links`` the number of other distinct sets that
    a row's set is linked with, ``n_copies`` the number of rows with its set, itself
    included, and ``first`` tells the one distinct row that stands for the class. Rows
    without words (null, empty) are alone: their class is their own id. Very long texts are
    compared whole. Null ids are kept and lose against others; repeated rows give equal results;
    an empty table gives none; other columns play no part. Tables are written when called.
    """
    spark = docs.sparkSession
    signed = sign(docs, words, trees)
    sets = distinct_sets(signed)
    bodies = columns(docs, "doc_id", "text").select("text", row_key().alias("rep_key")).where("text is not null")

    def texts(wanted: DataFrame) -> DataFrame:
        out = sets.select("node", "rep_key").join(wanted, "node").join(bodies, "rep_key").select("node", "text")
        return saved(out.groupBy("node").agg(F.first("text").alias("text")) if repeated(signed) else out)

    linked, cells, _ = forest_links(sets, texts, recall, words, trees)
    release(spark)
    labels = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cells.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    degrees = (
        linked.select(F.col("a").alias("node"), F.lit(1).alias("n"))
        .unionByName(linked.select(F.col("b").alias("node"), F.lit(1).alias("n")))
        .unionByName(cells.select("node", "n"))
        .groupBy("node")
        .agg(F.sum("n").alias("n_links"))
    )
    known = sets.join(labels, "node", "left").join(degrees, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = known.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("class_id"), "rep_key")).alias("best"))
    classes = known.join(best, "label").select("set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "best.class_id", F.col("best.rep_key").alias("first_key"))
    out = signed.where("n_shingles > 0").join(classes, "set_id").select(
        "key", "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "n_copies", "n_shingles", (F.col("key") == F.col("first_key")).alias("first")
    )
    alone = signed.where("n_shingles = 0").select(
        "key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "n_shingles", F.lit(True).alias("first")
    )
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs``, whole rows, with one row left of each class, that of the smallest doc_id.

    Classes are those of ``near_duplicates``. Rows without words (null, empty) all stay; very long
    texts are compared whole; null ids lose against others; of rows equal in id and text one
    stays; other columns, whatever their names, are kept; an empty table gives none. Tables are
    written when called.
    """
    found = near_duplicates(docs, **options)
    key, some = fresh(docs, "_key"), fresh(docs, "_some")
    stay = found.where("first").select(F.col("key").alias(key), (F.col("n_shingles") > 0).alias(some)).distinct()
    kept = docs.withColumn(key, row_key()).join(stay, key)
    if repeated(found):
        kept = kept.where(~F.col(some)).unionByName(kept.where(F.col(some)).dropDuplicates([key]))
    return kept.select(*[F.col(f"`{n}`") for n in docs.columns])
