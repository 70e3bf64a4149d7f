"""op2 and op8 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quirefold.llm import arrays
from quirefold.llm import rlz_dedup as rlz_module
from quirefold.llm import suffix_dedup as suffix_module
from quirefold.llm.arrays import words_hash
from quirefold.llm.blocks import HOT
from quirefold.llm.rlz_dedup import rlz_dedup
from quirefold.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, n_words string, block int"


def corpus(seed, small=False):
    rnd = random.Random(seed)
    vocab = ["a", "b"] if small else [f"w{i}" for i in range(50)] + ["é", "\xa0"]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 40))] for _ in range(5)]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.4 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 25))]
        docs.append((i, rnd.choice([" ", "  ", "\n"]).join(words), "x", 1))
    docs += [(60, None, None, None), (61, "", "x", 1), (62, " \t\n", "x", 2), (7, docs[7][1], "x", 1), (None, docs[8][1], None, None), (63, "ab ab " * 200, "", 3)]
    return docs


def windows(words, w):
    return [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]


def split(text):
    return [x.decode() for x in (text or "").encode().split()]


def brute_all(docs, w):
    c = Counter(x for d in docs for x in windows(split(d[1]), w))
    out = []
    for d in docs:
        words = split(d[1])
        gone = set()
        for i, x in enumerate(windows(words, w)):
            if c[x] > 1:
                gone.update(range(i, i + w))
        kept = " ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((d[0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_first(docs, w):
    first = {}
    for d in docs:
        for i, x in enumerate(windows(split(d[1]), w)):
            at = (-1 if d[0] is None else d[0], i)
            first[x] = min(first.get(x, at), at)
    out = []
    for d in docs:
        words, gone = split(d[1]), set()
        for i, x in enumerate(windows(words, w)):
            if first[x] != (-1 if d[0] is None else d[0], i):
                gone.update(range(i, i + w))
        out.append((d[0], len(words), len(gone), [x for i, x in enumerate(words) if i not in gone]))
    return sorted(out, key=str)


def test_rlz_matches_brute_force(spark):
    for seed, small, w, hot in ((1, False, 10, HOT), (2, True, 12, HOT), (3, False, 35, HOT), (1, False, 10, 2), (2, True, 12, 30), (7, True, 64, HOT)):
        docs = corpus(seed, small)
        rows = rlz_dedup(spark.createDataFrame(docs, SCHEMA), min_words=w, hot=hot).collect()
        got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows), key=str)
        assert got == brute_all(docs, w)


def test_suffix_matches_brute_force(spark):
    for seed, small, w, hot in ((4, False, 10, HOT), (5, True, 12, HOT), (6, False, 30, HOT), (4, False, 10, 2), (5, True, 12, 30), (7, True, 64, HOT)):
        docs = corpus(seed, small)
        rows = suffix_dedup(spark.createDataFrame(docs, SCHEMA), min_words=w, hot=hot).collect()
        got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), split(r.text)) for r in rows), key=str)
        assert got == brute_first(docs, w)
        assert {r.block for r in rows} == {1, 2, 3, None}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_swap_parts_differ(spark):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {len(r.spans) for r in rlz_dedup(docs).collect()} == {0}
    assert {len(r.spans) for r in suffix_dedup(docs, min_words=35).collect()} == {0}


def test_clashing_hashes_are_found_out(monkeypatch):
    rnd = random.Random(3)
    words, window, gram = [f"w{i}".encode() for i in range(6)], 12, 4
    contexts = [[rnd.choice(words) for _ in range(2 * window - gram)] for _ in range(6)]
    contexts += [c[:5] + contexts[0][5:] for c in contexts[1:3]] + [contexts[3][:17] + c[17:] for c in contexts[4:6]]
    joined = [b"".join(w + b" " for w in c) for c in contexts]
    k = len(joined)
    context = pa.table({"key": [7] * k, "sid": range(k), "block": pa.array([0] * k, pa.int32()), "lead": pa.array([window - gram] * k, pa.int32()), "n": pa.array([1] * k, pa.int32()), "words": pa.array(joined, pa.binary())})
    right = [b"".join(w + b" " for w in c[window - gram :]) for c in contexts]
    left = [b"".join(w + b" " for w in reversed(c[: window - gram])) for c in contexts]
    order = sorted(range(k), key=lambda i: (right[i], left[i]))
    take = lambda x: [x[i] for i in order]
    suffix = pa.table({"key": [7] * k, "n": pa.array([1] * k, pa.int32()), "right": pa.array(take(right), pa.binary()), "left": pa.array(take(left), pa.binary()), "doc": take(range(k)), "row": [0] * k, "pos": [0] * k})
    true = np.zeros(k, np.int64)
    for q in range(window - gram + 1):
        c = Counter(tuple(x[q : q + window]) for x in contexts)
        true |= np.array([(c[tuple(x[q : q + window])] > 1) << q for x in contexts])
    flip = lambda bits: [sum(1 << (window - gram - i) for i in range(window) if b >> i & 1) for b in bits.tolist()]
    for clash in (False, True):
        if clash:  # two of the words look alike
            for module in (rlz_module, suffix_module):
                monkeypatch.setattr(module, "words_hash", lambda *a: words_hash(*a) % np.uint64(5))
        assert rlz_module.repeated(context, window, gram).tolist() == true.tolist()
        again, first = suffix_module.compared(suffix, window, gram)
        assert flip(again) == take(true.tolist())
        assert all(f & ~a == 0 for a, f in zip(again.tolist(), first.tolist(), strict=True))


def test_words_hash_in_pieces(monkeypatch):
    rnd = random.Random(9)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.choice([1, 2, 7, 40, 5000]))) for _ in range(60)]
    text = b" ".join(words)
    data = np.frombuffer(text, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    letters = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)
    whole = words_hash(letters, data, starts, ends)
    short = np.array([len(w) < 4096 for w in words])
    monkeypatch.setattr(arrays, "_STEP", 13)
    assert (words_hash(letters, data, starts, ends) == whole).all()
    assert (words_hash(letters, data, starts[short], ends[short]) == whole[short]).all()
    assert len(set(whole.tolist())) == len(set(words)) and len(words_hash(letters, data, starts[:0], ends[:0])) == 0


def test_copies_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (None, text), (None, "x " + text), (3, text), (3, "y " + text)], "doc_id long, text string")
    rows = suffix_dedup(docs).collect()
    assert sorted(r.n_words - sum(s.end - s.start for s in r.spans) for r in rows) in ([0, 0, 1, 1, 60], [0, 0, 0, 1, 61])
    assert all(r.n_words == sum(s.end - s.start for s in r.spans) + ("y" in r.text) for r in rows if r.doc_id == 3)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rlz_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
