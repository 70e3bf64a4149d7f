"""op6: pieces against the tokenizers library, and the packing's own rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quirefold.llm import packing
from quirefold.llm.packing import best_fit, pack, sweep


def texts(seed):
    rnd = random.Random(seed)
    odd = ["", None, "  a  b\n\n c ", "it's we'll 123 4x", "é ß 漢字 \x1c\x85　x", "a<|endoftext|>b", "x" * 9000, "ab " * 9000]
    return odd + [" ".join(rnd.choice(["the", "of", "Zebra", "ünder", "42"]) for _ in range(rnd.randint(0, 3000))) for _ in range(60)]


def test_pack(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = list(enumerate(texts(1)))
    rows = pack(spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, "null id", 2)], "doc_id long, text string, offset int")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-total // 2048) * 1.1 + 1


def test_long_blank_runs(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_200_000, " " * 1_000_000 + "x", "a" + "\n" * 1_000_000 + "b c"]
    rows = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)


def test_sweep_gives_each_piece_the_least_free_gap(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 7)  # many ranges
    for seed in range(4):
        rnd = random.Random(seed)
        pieces = [(i, rnd.randint(1, 30)) for i in range(rnd.randint(1, 60))]
        slots = [(i, j, rnd.randint(1, 30)) for i in range(rnd.randint(1, 30)) for j in range(rnd.randint(1, 2))]
        got = sweep(
            spark.createDataFrame(pieces, "key long, length long"), spark.createDataFrame(slots, "seq long, slot int, size long"), len(pieces) + len(slots)
        ).collect()
        size = {(a, b): x for a, b, x in slots}
        assert sorted((r.key, r.length) for r in got) == pieces
        taken = [(r.seq, r.slot) for r in got if r.seq is not None]
        assert len(set(taken)) == len(taken)
        free, pairs = sorted(x for _, _, x in slots), []
        for _, n in sorted(pieces, key=lambda p: -p[1]):
            fit = min((g for g in free if g >= n), default=None)
            if fit is not None:
                free.remove(fit)
            pairs.append((n, fit))
        none = lambda p: (p[0], p[1] or 0)
        assert sorted(map(none, pairs)) == sorted(none((r.length, size.get((r.seq, r.slot)))) for r in got)


def test_near_best_fit_decreasing(spark):
    for seed, size, count in ((1, 100, 1500), (2, 37, 700), (3, 64, 1)):
        rnd = random.Random(seed)
        lengths = [rnd.randint(1, size - 1) if rnd.random() < 0.7 else 1 for _ in range(count)]
        rows = best_fit(spark.createDataFrame(list(enumerate(lengths)), "key long, length long"), size).collect()
        assert sorted(r.key for r in rows) == list(range(count))
        bins = defaultdict(list)
        for r in rows:
            bins[r.seq].append((r.offset, lengths[r.key]))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= size
        gaps = []
        for x in sorted(lengths, reverse=True):
            fit = min((g for g in gaps if g >= x), default=None)
            if fit is None:
                gaps.append(size - x)
            else:
                gaps.remove(fit)
                gaps.append(fit - x)
        assert len(bins) <= len(gaps) * 1.02 + 2


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
