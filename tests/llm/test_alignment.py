"""Cross-tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from millrace.llm import alignment as A

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "x", " ", "  two  spaces  ", "tab\tand\nline \n end ", "it's we'll I'd 've", "snow ▁ flake", "<|endoftext|> and <s> </s> <unk> <0x41>", "日本語のテキスト です 漢字", "a\x00b \x1c c\x1fd", "emoji 🙂🙃 x 🙂 y", "é combining ́x",
    "nb sp   em 　 wide", "Ünïcode — wörds… don't", "1234567 89 0x1f", "a  b", "end ", " start", "\n", "ﬁ ligature Å ½ ² ™", "ß ẞ ſ", "…" * 40, "!!! ??? ... a.b.c", "﻿bom ​ zero",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A_PATH)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = A.byte_letters()
    a_bytes = {i: bytes(letters.get(c, 0) for c in s) for s, i in t.get_vocab().items()}
    b_bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(m.id_to_piece(i) for i in range(m.get_piece_size()))]

    def encode(text):
        if not text:
            return None
        x, y = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        want = (" " + text).encode()
        if b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            return None
        return [(i, len(a_bytes[i])) for i in x], [(i, len(b_bytes[i])) for i in y]

    return encode


def spans(tokens):
    out, at = [], 0
    for i, n in tokens:
        out.append((i, at, at + n))
        at += n
    return out


def brute(texts, encode):
    found, counts = [], Counter()
    for text in texts:
        both = encode(text)
        if both is None:
            found.append(None)
            continue
        x, y = map(spans, both)
        links, k = [], 0
        for i, s, e in x:
            while y[k][2] <= s:
                k += 1
            j = k
            while j < len(y) and y[j][1] < e:
                links.append((i, y[j][0]))
                j += 1
        ends = sorted({e for _, _, e in x} & {e for _, _, e in y})
        parts, i, j = [], 0, 0
        for end in ends:
            a, b = [], []
            while i < len(x) and x[i][2] <= end:
                a.append(str(x[i][0]))
                i += 1
            while j < len(y) and y[j][2] <= end:
                b.append(str(y[j][0]))
                j += 1
            parts.append(",".join(a) + "|" + ",".join(b))
        counts.update(links)
        found.append((len(x), len(y), len(ends), links, ";".join(parts)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest())
        for f in found
    ]


def made(n):
    random.seed(12)
    pieces = ["the ", "word", "s ", " ", "  ", "\n", "Straße ", "été ", "日本", "x1 ", "don't ", "_a.b(c) ", "🙂", "\t", "▁", "0 ", "'s ", "é", "́", " "]
    weights = [9, 9, 9, 3, 2, 2, 3, 3, 1, 3, 3, 3, 1, 1, 0.05, 2, 2, 2, 1, 1]
    return ["".join(random.choices(pieces, weights, k=random.randrange(1, 60))) for _ in range(n)]


def sums(spark, texts, rows=None):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = A.C.written(A.alignments(frame, A_PATH, B_PATH, keep_groups=True), "alignment-test")
    counts = A.C.written(A.pair_counts(stored, 32000), "alignment-test-pairs")
    out = A.with_sums(stored, counts).orderBy("doc_id").collect()
    for r in out:
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 or not r.groups and r.groups_sha256 == ""
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out], stored


def test_alignment_against_brute_force(spark, libraries):
    texts = [None, "", *ODD, *made(300), "the word " * 30_000 + "end", "日本語" * 3000, *["copy of one"] * 30]
    got, stored = sums(spark, texts)
    assert got == brute(texts, libraries)
    assert sum(g[0] == 0 for g in got) >= 3 and sum(g[0] > 0 for g in got) > 250
    # products of the groups: every link lies in one, and as many pairs as the sizes' products
    pairs = A.products(stored.where("doc_id < 60"))
    want = Counter()
    for r in stored.where("doc_id < 60").collect():
        for k, g in enumerate(r.groups.split(";") if r.groups else []):
            a, b = g.split("|")
            want.update((r.doc_id, k, int(i), int(j)) for i in a.split(",") for j in b.split(","))
    assert Counter(tuple(r) for r in pairs.collect()) == want


def test_pairs_beyond_the_broadcast_are_joined(spark, libraries, monkeypatch):
    monkeypatch.setattr(A, "MOST_SENT", 25)
    texts = [None, *ODD, *made(80)]
    assert sums(spark, texts)[0] == brute(texts, libraries)


def test_small_runs_and_whole_texts(libraries, monkeypatch):
    """Documents over many runs, and libraries without cuts, give the same."""
    texts = [None, "", *ODD, *made(60), "the word " * 500]
    both = A.Aligner(A.read_bytes(A_PATH), A.read_bytes(B_PATH))
    assert both.cuts
    key = lambda found: [(f["counts"], f["sha"], [p.tolist() for p in f["pairs"]]) for f in found]
    want = key(both.aligned(texts, False))
    assert [w[1] for w in want] == [b[6] for b in brute(texts, libraries)]
    monkeypatch.setattr(A, "TOKENS", 40)
    monkeypatch.setattr(A, "KNOWN", 50)
    assert key(both.aligned(texts, False)) == want
    both.cuts = False
    assert key(both.aligned(texts, False)) == want


def test_elementary_intervals():
    import numpy as np

    ends, a, b, shared = A.elementary(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert (ends.tolist(), a.tolist(), b.tolist(), shared.tolist()) == ([2, 3, 5, 6, 9], [0, 1, 1, 2, 2], [0, 0, 1, 2, 3], [5, 9])


def test_alignment_of_defined_cases(spark, docs, none):
    rows = A.C.written(A.alignments(docs, A_PATH, B_PATH), "alignment-docs")
    assert rows.count() == docs.count()
    assert A.with_sums(A.alignments(none, A_PATH, B_PATH), A.pair_counts(A.alignments(none, A_PATH, B_PATH), 32000)).count() == 0
