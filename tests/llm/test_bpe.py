import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from basketry.llm import bpe

from .helpers import docs_of, odd_pairs, rows_of, sample, sha

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        data = f.read()
    mine = bpe.Bpe(data, P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return mine, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(both, spark):
    mine, lib = both
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab bAZ'sé0_\n\t  日🙂thein.<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts + [t for _, t in sample(spark)]:
        ids = mine.encode(t)
        assert ids.tolist() == lib.encode_ordinary(t) and mine.decode(ids) == t.encode()


def test_very_long_pre_tokens(both):
    mine, lib = both
    for t in ("a" * 100_000, "ab" * 30_000, "thein" * 4000, "é" * 5000):
        assert mine.encode(t).tolist() == lib.encode_ordinary(t)
    assert mine.decode(mine.encode("x" * 1_000_000)) == b"x" * 1_000_000


def test_memory_of_pre_tokens_is_bounded():
    with open(PATH, "rb") as f:
        small = bpe.Bpe(f.read(), P.PATTERN, remembered=5)
    text = " ".join(f"word{i}" for i in range(100))
    assert small.decode(small.encode(text)) == text.encode() and len(small.known) <= 5


def test_rows(spark, both):
    pairs = odd_pairs()
    encoded = bpe.encode_documents(docs_of(spark, pairs), PATH, P.PATTERN)
    want = sorted(((i, len(x), sha(" ".join(map(str, x))), sha(t or "")) for i, t in pairs for x in [both[1].encode_ordinary(t or "")]), key=repr)
    assert rows_of(bpe.token_digests(encoded)) == want
    again = bpe.decode_documents(encoded, PATH, P.PATTERN)
    assert rows_of(again.selectExpr("doc_id", "sha2(decoded, 256)")) == sorted(((i, sha(t or "")) for i, t in pairs), key=repr)
    assert bpe.encode_documents(docs_of(spark, []), PATH, P.PATTERN).count() == 0
