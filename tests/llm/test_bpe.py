"""op10 against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quirefold.llm.bpe import Bpe, encode


def texts():
    rnd = random.Random(5)
    parts = ["The", "quick", "it's", "WE'LL", "don't", "I'M", "x1y22", "3.14!!", "naïve", "Straße", "ΣΑΣ", "İstanbul", "漢字かな", "é", "\xa0", "\x1c", "\x85", "　", "a​b", "🎉🎉", "<|endoftext|>", "<|startoftext|>", "<|", "ﬁ", "ͅ", "½", "१२", "'S", "ǅ", " ", "|", "---", "a_b", "\x00"]
    out = ["", None, " ", "<|endoftext|>", "q" * 3000, "<|EndOfText|>"]
    return out + [rnd.choice(["", " "]).join(rnd.choice(parts) + rnd.choice(["", " ", "\n", "  "]) for _ in range(rnd.randint(1, 40))) for _ in range(300)]


def test_like_the_library(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    docs = list(enumerate(texts()))
    rows = {r.doc_id: r for r in encode(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ids string").repartition(4)).collect()}
    for i, t in docs:
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want, repr(t)
        assert rows[i].n_tokens == len(want)
        assert rows[i].decoded == tok.decode(want, skip_special_tokens=False), repr(t)


def test_merges_in_rank_order():
    bpe = Bpe(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    for _ in range(200):
        s = [rnd.choice(bpe.inner[97:123]) for _ in range(rnd.randint(1, 30))]
        want = list(s)
        while True:
            found = [(bpe.merges.get(a << 20 | b), i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False))]
            found = [x for x in found if x[0] is not None]
            if not found:
                break
            m, i = min(found)
            want[i : i + 2] = [m & 0xFFFFF]
        assert bpe.merge(list(s)) == want


def test_empty(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_code_point_and_newer_marks():
    """Unassigned and new code points too: their classes and normal forms are the library's."""
    from quirefold.llm.bpe import _Kept

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    table = _Kept(Bpe(path))
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]]
    mixed = [f"a{x}b1{x}{x}." for x in points]
    rnd = random.Random(4)
    odd = [chr(c) for c in (0xD3B, 0x36F, 0x558, 0x58B, 0x1C89, 0x208F, 0x301, 0x345, 0xC5C, 0x41, 0xE9, 0x3A3)]
    mixed += ["".join(rnd.choices(odd, k=6)) for _ in range(3000)]
    for lo in range(0, len(mixed), 2000):
        text = " ".join(mixed[lo : lo + 2000])
        want = tok.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(table.encode(text)[0], "<u4").tolist()
        if got != want:
            bad = [x for x in mixed[lo : lo + 2000] if np.frombuffer(table.encode(x)[0], "<u4").tolist() != tok.encode(x, add_special_tokens=False).ids]
            raise AssertionError(ascii(bad[:20]))
