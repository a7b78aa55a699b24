import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from basketry.llm import ngram_join as nj
from basketry.llm.decontaminate import words_of

from .helpers import docs_of, odd_pairs, sample


def shingles(t):
    w = words_of((t or "").encode())
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def plain(pairs):
    sets = [shingles(t) for _, t in pairs]
    copies = Counter(sets)
    reps = [s for s in copies if s]
    links, root = defaultdict(set), list(range(len(reps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(reps)):
        for b in range(a):
            n = len(reps[a] & reps[b])
            if 5 * n >= 4 * (len(reps[a]) + len(reps[b]) - n):
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    number = {s: i for i, s in enumerate(reps)}
    best = {}
    for (i, _), s in zip(pairs, sets):
        if s and i is not None:
            r = find(number[s])
            best[r] = min(best.get(r, i), i)
    return sorted(((i, best.get(find(number[s])), len(links[number[s]]), copies[s]) if s else (i, i, 0, 1) for (i, _), s in zip(pairs, sets)), key=repr)


def near_copies(n, seed=1, length=60):
    rng = random.Random(seed)
    base = [f"b{rng.randint(0, 500)}" for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(length)] = f"n{rng.randint(0, 9)}"
        out.append((5000 + i, " ".join(w)))
    return out


def got(df):
    return sorted(map(tuple, df.select("doc_id", "class_id", "n_links", "n_copies").collect()), key=repr)


def test_against_plain(spark):
    pairs = odd_pairs() + near_copies(60) + sample(spark, 120)
    want = plain(pairs)
    assert got(nj.near_duplicates(docs_of(spark, pairs))) == want
    assert max(x[2] for x in want) > 5


def test_large_nodes_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nj, "FEW", 4)
    monkeypatch.setattr(nj, "CHUNK", 16)
    pairs = near_copies(150, 7) + near_copies(5, 8) + [(1, "a b c d e f"), (2, "a b c d e f"), (3, "A, b c d e! f")]
    assert got(nj.near_duplicates(docs_of(spark, pairs))) == plain(pairs)


def test_one_of_each_class_stays(spark):
    pairs = odd_pairs() + near_copies(20)
    docs = docs_of(spark, pairs)
    kept = nj.drop_near_duplicates(docs)
    classes = {x[1] for x, (_, t) in zip(plain(pairs), pairs)}
    assert kept.columns == docs.columns and {r[0] for r in kept.select("_key").collect()} == {"x"}
    texts = [r[0] for r in kept.select("text").collect()]
    with_words = [t for t in texts if shingles(t)]
    assert len(with_words) == len({x[1] for x in plain(pairs) if x[1] is not None} - {i for i, t in pairs if not shingles(t)})
    assert classes and sum(not shingles(t) for t in texts) == sum(not shingles(t) for _, t in pairs)


def test_empty(spark):
    assert nj.near_duplicates(docs_of(spark, [])).count() == 0 and nj.drop_near_duplicates(docs_of(spark, [])).count() == 0


def test_depth_follows_the_links():
    """Links of high similarity are found at long prefixes; those near the threshold, or few ones, need short ones."""
    d = nj.least_depth()
    assert nj.found_share(0.8, d) >= nj.RECALL > nj.found_share(0.8, d + 1)
    assert nj.next_depth(nj.LONGEST, {98: 10**7}) == nj.LONGEST > nj.next_depth(nj.LONGEST, {85: 10**7}) > nj.next_depth(nj.LONGEST, {80: 10**7}) == d
    assert nj.next_depth(nj.LONGEST, {}) == nj.next_depth(nj.LONGEST, {98: 3}) == d  # too little seen to tell
    assert nj.next_depth(6, {98: 10**7}) == 6


def test_depth_used_depends_on_the_data(spark):
    """Many links of high similarity end the search sooner than many at the threshold."""

    def copies(n_words, changed, groups, each, seed):
        rng, out = random.Random(seed), []
        for g in range(groups):
            base = [f"g{g}w{i}" for i in range(n_words)]
            for k in range(each):
                w = list(base)
                for i in rng.sample(range(n_words), changed):
                    w[i] = f"x{g}y{k}z{i}"
                out.append((len(out), " ".join(w)))
        return out

    def depth(pairs, recall):
        docs = docs_of(spark, pairs)
        sets = nj.distinct_sets(nj.sign(docs))
        texts = lambda wanted: sets.select("node", "rep").join(wanted, "node").join(docs.select("doc_id", "text"), F.col("rep") == F.col("doc_id")).select("node", "text")
        return nj.forest_links(sets, texts, recall)[2]

    alike, less = copies(300, 1, 150, 4, 1), copies(90, 1, 150, 4, 2)
    assert depth(alike, 0.999) > depth(less, 0.999) >= nj.least_depth(0.999)


def test_recall_of_the_forest(spark):
    """Links at the threshold itself: found ones against all."""
    rng = random.Random(3)
    pairs = []
    for g in range(300):  # 96 shingles, of which 10 or 11 aren't shared
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(2):
            w = list(base)
            w[rng.choice((20, 50, 80))] = f"g{g}k{k}"
            w[99 if k else 0] = f"g{g}e{k}"
            pairs.append((2 * g + k, " ".join(w)))
    want = sum(x[2] for x in plain(pairs))
    for recall in (0.9, nj.RECALL):
        found = sum(r["n_links"] for r in nj.near_duplicates(docs_of(spark, pairs), recall=recall).collect())
        assert want > 150 and found >= recall * want
    assert found == want


def test_signatures_meet_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    sh, met = nj.Shingler(5, nj.TREES, nj.LONGEST), 0
    for _ in range(300):
        core, a, b = rng.integers(0, 1 << 63, 80, np.uint64) * np.uint64(2), *rng.integers(0, 1 << 63, (2, 10), np.uint64)
        x, y = (np.frombuffer(s, "<u2") for s in sh.signatures([np.unique(np.concatenate((core, a))), np.unique(np.concatenate((core, b)))]))
        met += (x == y).mean() / 300
    assert abs(met - 0.8) < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["label"] for r in nj.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_matrix_products():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randint(0, 60) for _ in range(rng.randint(1, 40))], np.uint64)) for _ in range(30)]
    both = nj._overlaps(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30))
