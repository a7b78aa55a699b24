"""Tables that every operator must stand, and plain versions of what they compute."""

import hashlib
import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, term string, digest string, _key string, node long"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def docs_of(spark, pairs, lang="en"):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "k", "t", "d", "x", 1) for i, t in pairs], DOCS)


def odd_pairs():
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "groß", "42", "x-y", "日本語"]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    body = " ".join(f"w{i}" for i in range(80))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (5, long), (6, body), (7, body + " tail"), (8, "head " + body), (8, "other text with the same id"),
        (None, body), (None, None), (9, "!!! ??? ..."), (10, "short"), (11, "a" * 50_000), (12, body), (13, "x y z"),
    ]


def sample(spark, n=400):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
