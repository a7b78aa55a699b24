import random

import numpy as np
import public_tokenizers as P
import pytest

from basketry.llm import token_counts as tc
from basketry.llm.bpe import Bpe

from .helpers import docs_of, odd_pairs, rows_of, sample

PATH = P.path("byte_bpe_50k.tiktoken")


def plain(pairs):
    with open(PATH, "rb") as f:
        bpe = Bpe(f.read(), P.PATTERN)
    return sorted(((i, len(bpe.encode(t or ""))) for i, t in pairs), key=repr)


@pytest.mark.parametrize("block", [4 << 20, 1000, 2])
def test_against_an_encoder(spark, block):
    pairs = (odd_pairs() if block > 2 else [(1, None), (2, "a b"), (2, "a b"), (None, "x")]) + sample(spark, 10 if block == 2 else 100)
    assert rows_of(tc.token_counts(docs_of(spark, pairs), PATH, P.PATTERN, 50256, block=block)) == plain(pairs)


def test_flat_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tc, "GROUP", 3)
    rng, want = random.Random(1), []
    for n in range(4):
        data, k, size = [], 0, 0
        for _ in range(rng.randint(0, 60)):
            if rng.random() < 0.4:
                data.append(7)
                want.append((n, k, size))
                k, size = k + 1, 0
            else:
                data.append(rng.randint(8, 99))
                size += 1
        if size:
            want.append((n, k, size))
        (tmp_path / f"{n}.tokens").write_bytes(np.array(data, "<u4").tobytes() + b"x" * (n % 2))
    files = tc.list_token_files(spark, f"file://{tmp_path}")
    for block in (4, 12, 64):
        got = tc.scan_token_files(files.unionAll(files), 7, "<u4", block).collect()
        assert sorted((int(r["file"].rsplit("/", 1)[1][0]), r["ordinal"], r["n_tokens"]) for r in got) == sorted(want)


def test_empty_and_wrong(spark):
    assert tc.token_counts(docs_of(spark, []), PATH, P.PATTERN, 50256).count() == 0
    with pytest.raises(ValueError):
        tc.write_token_files(docs_of(spark, []), PATH, P.PATTERN, 70_000)
