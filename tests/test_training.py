"""Byte-pair training in cut segments against its definition."""

import random

import pytest

from textloom.operators import tokenizer


def naive_merges(texts, merges):
    rows, out = [list(t) for t in texts], []
    for _ in range(merges):
        count = {}
        for r in rows:
            for p in zip(r, r[1:]):
                count[p] = count.get(p, 0) + 1
        if not count:
            break
        n, (a, b) = max((n, p) for p, n in count.items())
        out.append((a, b, n))
        for r in rows:
            i = 0
            while i < len(r) - 1:
                if (r[i], r[i + 1]) == (a, b):
                    r[i : i + 2] = [a + b]
                i += 1
    return out


@pytest.mark.parametrize("local, block", [(10**6, 50), (10**6, 10**6), (0, 50)])
def test_training_on_segments_equals_its_definition(spark, monkeypatch, local, block):
    for name, value in (("OPEN", 3), ("LOCAL", local), ("BLOCK", block), ("PENDING", 5)):
        monkeypatch.setattr(tokenizer, name, value)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefghijkl é𝓐\0\n") for _ in range(rng.randrange(80))) for _ in range(80)]
    texts += ["aaaa", "aaaaa", "", "x", "zz", "qz"] + texts[:7]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    asked = []
    inner = tokenizer._segments
    monkeypatch.setattr(tokenizer, "_segments", lambda df, text, opened: asked.append(len(opened)) or inner(df, text, opened))
    assert tokenizer.train_merges(df, "text", 60) == naive_merges(texts, 60)
    assert len(asked) > 1 and asked == sorted(asked)


def test_sums_of_large_weights_are_exact():
    import numpy as np

    got = tokenizer._weighted([(np.array([1, 1]), np.array([2**55 + 1, 2**55 + 2], np.int64)), (np.array([3]), np.array([5]))], 2)
    assert got.tolist() == [0, 2**56 + 3, 0, 5]
