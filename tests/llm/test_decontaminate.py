import random
import re

from basketry.llm import decontaminate as d

from .helpers import SF, docs_of, odd_pairs, rows_of, sample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(pairs, bench, n=13):
    wins = []
    for item, t in bench:
        w = words(t)
        if w:
            wins += [(item, tuple(w[i : i + n])) for i in range(max(1, len(w) - n + 1))]
    out = []
    for i, t in pairs:
        w, hit, items = words(t), set(), set()
        at = {}
        for s in range(len(w)):
            at.setdefault(w[s], []).append(s)
        for item, win in wins:
            for s in at.get(win[0], ()):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    items |= set() if item is None else {str(item)}
        out.append((i, len(w), len(hit), tuple(sorted(items)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in df.collect()), key=repr)


def bench_of(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id long, text string, term string")


def test_against_plain(spark):
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    body = " ".join(f"W{i}" for i in range(80))
    bench += [(900, "short"), (901, None), (902, "..."), (903, " ".join(f"w{i}" for i in range(20, 45))), (904, " ".join(f"w{i}" for i in range(30, 50))), (905, "w1 w1 w1"), (None, body), (906, "w1 w1 w1")]
    pairs = odd_pairs() + [(20, "w1 W1 w1 w1 w1"), (21, "a " + "w1-w1.w1"), (22, body)] + sample(spark)
    want = plain(pairs, bench)
    assert got(d.decontaminate(docs_of(spark, pairs), bench_of(spark, bench))) == want
    assert any(x[4] for x in want)
    # terms in several blocks, and more anchors, change nothing
    assert got(d.decontaminate(docs_of(spark, pairs), bench_of(spark, bench), anchors=3, limit=200)) == want


def test_empty_tables(spark):
    none, bench = docs_of(spark, []), bench_of(spark, [(1, "one two")])
    assert d.decontaminate(none, bench).count() == 0
    assert got(d.decontaminate(docs_of(spark, [(1, "one two")]), bench_of(spark, []))) == [(1, 2, 0, (), False)]


def test_drop_contaminated(spark):
    docs = docs_of(spark, [(1, "one two three"), (2, "other words"), (2, "other words"), (3, None)])
    kept = d.drop_contaminated(docs, bench_of(spark, [(1, "two three")]))
    assert kept.columns == docs.columns and rows_of(kept.select("doc_id")) == [(2,), (2,), (3,)]


def near_of(spark, pairs, bench, **options):
    rows = d.decontaminate(docs_of(spark, pairs), bench_of(spark, bench), **options).collect()
    return sorted((r["doc_id"], [tuple(x) for x in r["near"]]) for r in rows)


def plain_near(pairs, bench, window, slop):
    """Of two-word windows: the rarer word's places with the other one close, and how far it is."""
    lists, out = {i: words(t) for i, t in pairs}, []
    df = {w: sum(w in x for x in lists.values()) for _, t in bench for w in words(t)}
    for i, w in sorted(lists.items()):
        found = {}
        for _, t in bench:
            terms = sorted(set(words(t)), key=lambda x: (df[x], x))
            if df[terms[0]] and all(x in w for x in terms):
                for at in (k for k, x in enumerate(w) if x == terms[0]):
                    span = max((min(abs(k - at) for k, x in enumerate(w) if x == other) for other in terms[1:]), default=0)
                    if span < window + slop:
                        found[at] = min(span, found.get(at, span))
        out.append((i, sorted(found.items())))
    return out


def test_proximity(spark):
    pairs = [(1, "red fox and the blue owl"), (2, "owl " + "x " * 40 + "fox"), (3, "fox"), (4, "fox owl fox")]
    bench = [(1, "fox sees owl"), (2, "fox owl")]
    # the window with a word that no document has is gone
    assert near_of(spark, pairs, bench, window=6, slop=0) == plain_near(pairs, [bench[1]], 6, 0)
    far = near_of(spark, pairs, bench, window=6, slop=60)
    assert far == plain_near(pairs, [bench[1]], 6, 60) and [i for i, n in far if n] == [1, 2, 4]
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    bench = [(i, " ".join(rng.sample("abcdefghi", rng.randint(1, 2)))) for i in range(12)]
    assert near_of(spark, pairs, bench, window=3, slop=1) == plain_near(pairs, [x for x in bench if "i" not in x[1]], 3, 1)


def test_repeated_contaminated_rows(spark):
    pairs = [(1, "one two three"), (1, "one two three"), (1, "one two three"), (2, "fox owl"), (2, "fox owl"), (3, "two words"), (3, "two words")]
    bench = [(7, "two three"), (8, "one two three"), (9, "owl")]
    want = plain(pairs, bench)
    assert [x[4] for x in want] == [True] * 5 + [False] * 2
    docs = docs_of(spark, pairs)
    assert got(d.decontaminate(docs, bench_of(spark, bench))) == want
    assert rows_of(d.drop_contaminated(docs, bench_of(spark, bench)).select("doc_id")) == [(3,), (3,)]


def test_proximity_of_repeated_rows(spark):
    pairs = [(1, "red fox and the blue owl"), (1, "red fox and the blue owl"), (2, "blue only"), (2, "blue only")]
    got_ = near_of(spark, pairs, [(1, "fox sees owl"), (2, "fox owl"), (3, "blue")], window=6, slop=0)
    assert got_ == [(1, [(1, 4), (4, 0)])] * 2 + [(2, [(0, 0)])] * 2


def test_a_common_window_and_a_repeated_word(spark):
    """A window that 10,000 items share is tried once, and its items are looked up after it is found."""
    bench = [(i, "na " * 20) for i in range(10_000)] + [(10_000, "na " * 12 + "batman")]
    pairs = [(1, "na " * 100_000), (2, "na na na"), (3, "na " * 12 + "batman")]
    rows = {r["doc_id"]: r for r in d.decontaminate(docs_of(spark, pairs), bench_of(spark, bench)).collect()}
    assert (rows[1]["n_hit"], len(rows[1]["items"])) == (100_000, 10_000) and rows[1]["items"] == sorted(map(str, range(10_000)))
    assert rows[2]["n_hit"] == 0 and (rows[3]["n_hit"], rows[3]["items"]) == (13, ["10000"])
    cuts = d.item_windows(bench_of(spark, bench))
    assert d.distinct_windows(cuts).count() == 2


def test_items_without_id(spark):
    bench = [(None, "two three"), (5, "two three four")]
    want = plain([(1, "one two three"), (2, "two three four")], bench)
    assert got(d.decontaminate(docs_of(spark, [(1, "one two three"), (2, "two three four")]), bench_of(spark, bench))) == want and want[0][2:4] == (2, ())
