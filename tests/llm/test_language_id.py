import math
import random
import re
import subprocess
import sys

import pyarrow as pa

from basketry.llm import language_id as li

from .helpers import SF, docs_of, odd_pairs


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_labels_of_held_out_rows_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    wrong = docs.withColumn("lang", F.when(li.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = {r["doc_id"]: r["lang_pred"] for r in li.identify(docs).collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in li.identify(wrong).collect()}
    assert a == b and "xx" not in b.values()


def model_of(spec, languages=("a", "b")):
    """A model of {(size, gram): counts by language}."""
    rows = [(size, gram, lang, n) for (size, gram), counts in spec.items() for lang, n in zip(languages, counts) if n]
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
    return li.model_of(pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["size", "gram", "lang", "n"]))


def plain(spec, text, languages=("a", "b")):
    """Log frequency by language, summed over words, and the mean share of each language."""
    totals = {n: [sum(c[i] for (k, _), c in spec.items() if k == n) + 0.5 * sum(k == n for k, _ in spec) + 1 for i in range(len(languages))] for n in range(6)}
    logs = lambda n, g: [math.log((spec[n, g][i] + 0.5) / totals[n][i]) for i in range(len(languages))]
    total, shares, n_words = [0.0] * len(languages), [0.0] * len(languages), 0
    for run in re.findall(r"[^\W\d_]+", text.lower()):
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            n_words += 1
            one = [0.0] * len(languages)
            if (0, word) in spec:
                one = logs(0, word)
            else:
                for n in range(5, 0, -1):
                    padded = f" {word} " if n > 1 else word
                    known = [logs(n, g) for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if (n, g) in spec]
                    if known:
                        one = [sum(k[i] for k in known) / len(known) for i in range(len(languages))]
                        break
            weights = [math.exp(x - max(one)) for x in one]
            total = [t + x for t, x in zip(total, one)]
            shares = [s + w / sum(weights) for s, w in zip(shares, weights)]
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    best = max(range(len(languages)), key=lambda i: (total[i], -i))
    return languages[best], shares[best] / n_words


def test_against_plain(monkeypatch):
    rng = random.Random(2)
    letters, spec = "abcde", {}
    for n in range(6):
        for _ in range((30, 4, 12, 20, 20, 20)[n]):
            gram = "".join(rng.choice(letters) for _ in range(n or rng.randint(1, 4)))
            counts = (rng.choice((0, 1, 5, 40)), rng.choice((0, 1, 5, 40)))
            if any(counts):
                spec[n, gram] = counts
    judge = li.Judge(model_of(spec))
    texts = [" ".join("".join(rng.choice(letters + "Z9²½Ⅷ-,") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for segment, at_once in ((1 << 19, 8 << 20), (7, 100)):
        monkeypatch.setattr(li, "SEGMENT", segment)
        monkeypatch.setattr(li, "AT_ONCE", at_once)
        for (name, score, _), t in zip(judge.judge(texts), texts):
            want = plain(spec, t)
            assert name == want[0] and abs(score - want[1]) < 1e-9, t


def test_backoff():
    spec = {(0, "known"): (9, 1), (1, "z"): (1, 5), (2, "zz"): (0, 7)}
    judge = li.Judge(model_of(spec))
    assert judge("known known, KNOWN")[0] == "a" and judge("zzz")[0] == "b" and judge("12 !") == judge(None) == judge("") == ("und", 0.0)
    assert judge("qqq") == ("a", 0.5)  # silent: a tie


def test_only_letters_have_a_language():
    judge = li.Judge(model_of({(0, "x"): (3, 1)}))
    for t in ("\u00b2", "\u00bd", "\u2167", "\u2460 \u00b9\u00b3", "_ 12 !"):
        assert judge(t) == ("und", 0.0), t
    assert judge("x\u00b2")[0] == judge("\u00b2x")[0] == "a"


LONG = """
import resource
from basketry.llm import language_id as li
from tests.llm.test_language_id import model_of
languages = tuple(f"l{i:03}" for i in range(200))
judge = li.Judge(model_of({(0, f"w{chr(97 + i)}"): tuple(int(j % 26 == i) for j in range(200)) for i in range(26)}, languages))
text = " ".join(f"w{chr(97 + i % 13)}" for i in range(6_700_000))  # 20 MB
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert judge(text)[0] == "l000"
judge("w" * 2_000_000)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_long_texts_and_many_languages_take_bounded_memory():
    used = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, check=True).stdout
    assert int(used) < 200 << 10


def test_languages_without_number(spark):
    """A language of few rows among many is learnt like any other."""
    word = lambda i: chr(97 + i // 26) + chr(97 + i % 26) * 3
    rows = [(10 * i + k, f"{word(i)} {word(i)}x", f"l{i}") for i in range(300) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = li.identify(docs).join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() == len(rows)


def test_what_the_pipeline_drops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    salad = [(-i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(200)), None) for i in range(1, 21)]
    greek = [(-100, "η γάτα κάθεται στο τραπέζι και κοιτάζει έξω " * 5, None), (-101, "12 !", None), (-102, None, None), (-103, "", None)]
    kept = {r[0] for r in li.keep_identified(docs.unionByName(spark.createDataFrame(salad + greek, docs.schema))).select("doc_id").collect()}
    clean = {r[0] for r in docs.where("text rlike '[a-zA-Z]'").select("doc_id").collect()}
    assert len(kept & clean) >= 0.999 * len(clean) and not any(i < 0 for i in kept)


def test_odd_rows(spark):
    docs = docs_of(spark, odd_pairs())
    got = li.identify(docs).collect()
    assert len(got) == docs.count()
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {1, 2, 3, 9} <= und and all(r["held_out"] is False for r in got if r["doc_id"] is None)
    assert li.keep_identified(docs).columns == docs.columns
    none = docs_of(spark, [(1, "some text")], lang=None)
    assert [(r["lang_pred"], r["score"]) for r in li.identify(none).collect()] == [("und", 0.0)]
    assert li.identify(docs_of(spark, [])).count() == 0


def test_sample_is_bounded(spark):
    docs = docs_of(spark, [(i, "text") for i in range(4000)])
    assert 60 < li.learning_rows(docs, 100).count() < 150
