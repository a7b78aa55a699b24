import random

from basketry.llm.substring_dedup import covered, substring_dedup

from .helpers import docs_of, odd_pairs, sample, sha


def plain(pairs, n=50):
    first = {}
    lists = [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in lists:
        if i is not None:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in lists:
        gone = set()
        for s in range(len(w) - n + 1):
            if i is not None and first[tuple(w[s : s + n])] < i:
                gone.update(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def test_against_plain(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(40)]
    blocks = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 90))] for _ in range(12)]
    made = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            b = list(rng.choice(blocks))
            if rng.random() < 0.5 and b:
                b[rng.randrange(len(b))] = rng.choice(vocabulary)
            words += b[rng.randint(0, 10) :] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        made.append((1000 + rng.randint(0, 100), rng.choice([" ", "\n", "  "]).join(words)))
    pairs = odd_pairs() + made + [(2000, "z " * 300), (2001, "z " * 200)]
    want = plain(pairs)
    assert got(substring_dedup(docs_of(spark, pairs))) == want
    assert sum(x[2] for x in want) > 1000


def test_small_windows_and_data(spark):
    pairs = sample(spark, 150)
    for n, k in ((12, 4), (5, 5)):
        assert got(substring_dedup(docs_of(spark, pairs), n, k)) == plain(pairs, n)


def test_empty_and_text(spark):
    assert substring_dedup(docs_of(spark, [])).count() == 0
    body = [f"w{i}" for i in range(60)]
    rows = {r["doc_id"]: r for r in substring_dedup(docs_of(spark, [(1, " ".join(body)), (2, "a  b " + " ".join(body) + "\nc")])).collect()}
    assert rows[1]["kept"] is None and rows[2]["kept"] == "a b c" and rows[2]["n_removed"] == 60


def test_factors_cover_copies(spark):
    """A copy is one factor, also where one of its lines stands in an even smaller document; edges are looked up."""
    line = " ".join(f"common{i}" for i in range(80))
    body = lambda n, k: " ".join(f"{k}{i}" for i in range(n))
    passage = body(150, "p") + " " + line + " " + body(150, "q")
    pairs = [(1, body(60, "a") + " " + line + " " + body(60, "b")), (2, body(70, "c") + " " + passage), (3, passage + " " + body(30, "d")), (4, "x " + passage + " y")]
    rows = {r["doc_id"]: r for r in substring_dedup(docs_of(spark, pairs)).collect()}
    assert got(substring_dedup(docs_of(spark, pairs))) == plain(pairs)
    assert rows[3]["n_removed"] == rows[4]["n_removed"] == 380 and rows[2]["n_removed"] == 80
    assert rows[3]["in_factors"] > 150 and rows[4]["in_factors"] > 150
    long = body(5000, "w")
    rows = {r["doc_id"]: r for r in substring_dedup(docs_of(spark, [(1, long), (2, long)])).collect()}
    assert rows[2]["n_removed"] == 5000 and rows[2]["in_factors"] > 4850


def test_covered(spark):
    df = spark.createDataFrame([([(0, 5), (3, 9), (20, 25), (21, 22)],), ([],)], "s array<struct<start: long, end: long>>")
    assert [r[0] for r in df.select(covered("s")).collect()] == [14, 0]
