"""Cross-tokenizer alignment against plain Python, with the first tokenizer's own library."""

import collections
import hashlib
import random
import sys

import pytest
import sentencepiece
import tokenizers

from sluice.llm import alignment

SCHEMA = "doc_id long, text string, source string, row long, pairs string"
FOLDER = alignment.TOKENIZERS


@pytest.fixture(scope="module")
def libraries():
    one = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def unbyte():
    """Characters of byte-level tokens and their bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_force(libraries, texts):
    one, two = libraries
    byte, groups = unbyte(), []
    for t in texts:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        x = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, two.id_to_piece(i)) for i in b)]
        found = []
        if t and b"".join(x) == b"".join(y) == (" " + t).encode():
            i = j = 0
            while i < len(a):
                k, m, left, right = i + 1, j + 1, len(x[i]), len(y[j])
                while left != right:
                    if left < right:
                        left, k = left + len(x[k]), k + 1
                    else:
                        right, m = right + len(y[m]), m + 1
                found.append((a[i:k], b[j:m]))
                i, j = k, m
        groups.append(found)
    count = collections.Counter(p for found in groups for p in {(a, b) for g in found for a in g[0] for b in g[1]})
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for found in groups:
        links = [(a, b) for g in found for a in g[0] for b in g[1]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in found)
        out.append((sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), hashlib.sha256(text.encode()).hexdigest() if found else "", len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    bits = ["the", "tokenisation", " ", "  ", "\n", "\t", "1984", "naïve", "straße", "日本語", "😀", "ﷺ", "!?", "don't", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "▁", "\x00", "\x85", "　", "é", "xyzzy", "ÀÉ", "\r\n", " " * 30, "aaaa" * 9, "…", "ſ", "Ⅷ", "½"]
    return ["".join(rng.choice(bits) + rng.choice(("", " ")) for _ in range(rng.choice((0, 1, 2, 9, 60)))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_alignment_as_by_force(spark, libraries, frequent):
    texts = [*corpus(frequent), None, "", "▁", "same words here", "same words here", "word " * 3000]
    rows = [(None if i == 3 else i // 2 if i < 6 else i, t, "s", 1, "p") for i, t in enumerate(texts)]
    got = sorted(map(str, ((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in alignment.linked(spark.createDataFrame(rows, SCHEMA).repartition(3), frequent=frequent).collect())))
    assert got == sorted(str((r[0], *x)) for r, x in zip(rows, by_force(libraries, [t or "" for t in texts])))


def test_texts_one_by_one(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "TEXT", 10)
    texts = corpus(5, 20)
    for t, x in zip(texts, by_force(libraries, texts)):
        found = alignment.aligned(FOLDER, [t]).to_pylist()[0]
        assert (found["n_a"], found["n_b"], found["n_groups"], found["groups_sha256"], sum(found["weights"])) == x[:5]


def test_no_rows(spark):
    assert alignment.linked(spark.createDataFrame([], SCHEMA)).collect() == []
    got = alignment.linked(spark.createDataFrame([(1, None, "", 1, "")], SCHEMA)).collect()
    assert [tuple(r.asDict()[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")) for r in got] == [(1, 0, 0, 0, "", 0, 0, 0)]


def test_both_libraries_split_alike(libraries):
    """The encoder in use gives the ids of the other library for every character of the basic plane and
    samples beyond it, in places that tell letters, digits, spaces and other characters apart."""
    own = alignment.ByteLevel(FOLDER)
    for at in range(0, sys.maxunicode, 4096):
        codes = [c for c in range(at, at + 4096, 1 if at < 0x10000 else 61) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b 1{c}2 {c} {c}!{c}\n" for c in map(chr, codes)]
        assert own.ids(texts) == [e.ids for e in libraries[0].encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
