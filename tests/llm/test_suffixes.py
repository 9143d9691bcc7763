"""Suffix-array dedup against plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest

from sluice.llm import suffixes

SCHEMA = "doc_id long, text string, source string, gram long, x long"


def test_suffix_array_is_the_sorted_order():
    rng = random.Random(4)
    texts = [[], [1], [2, 1], [1] * 50, [1, 2] * 40, list(b"mississippi"), [3, 2, 1] * 9 + [3, 2]]
    texts += [[rng.randint(1, rng.choice((1, 2, 4, 90))) for _ in range(rng.randint(0, 300))] for _ in range(300)]
    got = suffixes.suffix_arrays([np.array(t, np.int16) for t in texts])
    for t, order in zip(texts, got, strict=True):
        assert order.tolist() == sorted(range(len(t) + 1), key=lambda i: t[i:])
    assert suffixes.suffix_arrays([np.array(texts[4], np.int16)])[0].tolist() == got[4].tolist()


def by_force(texts):
    W = suffixes.WINDOW
    times = collections.Counter(t[i : i + W] for t in texts for i in range(len(t) - W + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - W + 1):
            if times[t[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        left = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
    return out


def corpus(seed, n=50):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß ") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, line = prose(120), prose(6)
    texts = []
    for i in range(n):
        t = prose(rng.choice((0, 3, 60, 70, 80, 300)))
        if i % 3 == 0:
            t += passage[rng.randint(0, 40) :] + prose(rng.randint(0, 50))
        if i % 5 == 1:
            t += line * rng.randint(1, 30)
        if i % 7 == 2:
            t += rng.choice("-= ") * rng.randint(380, 1500)
        if i % 6 == 5:
            t = texts[i // 2].replace("a", "aa", rng.randint(0, 3))
        texts.append(t)
    return texts


def check(spark, texts, parts=3):
    rows = [(None if i == 4 else i // 2 if i < 8 else i, t, "s", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted(((r.doc_id, *tuple(r)[1:5], bytes(r.kept)) for r in suffixes.without_repeated_bytes(df).collect()), key=str)
    want = sorted(((r[0], *f) for r, f in zip(rows, by_force([(t or "").encode() for t in texts]))), key=str)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_go_as_by_force(spark, seed):
    texts = corpus(seed)
    check(spark, [*texts, None, "", texts[3], texts[9][:399], texts[9][:400], texts[9][1:402]])


@pytest.mark.parametrize("pieces", [1, 4, 20])
def test_hot_grams_are_split(spark, monkeypatch, pieces):
    """A passage in most documents, with contexts of their own; few pieces per part."""
    monkeypatch.setattr(suffixes, "STEPS", tuple((pieces, step) for _, step in suffixes.STEPS))
    monkeypatch.setattr(suffixes, "SHARD", 5000)
    check(spark, corpus(pieces, 40))


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    check(spark, corpus(8, 30))


def test_an_empty_table(spark):
    assert suffixes.without_repeated_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
