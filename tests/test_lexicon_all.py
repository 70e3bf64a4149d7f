"""Dictionary replacement over every document, and overlapping terms against brute force."""

import random

from quirefold.operators.lexicon import replace_terms
from quirefold.plans import registry
from quirefold.session import table

SF = "/root/testdata/sf0.001"


def brute(text, terms):
    out, at = [], 0
    while at < len(text):
        hit = max((t for t in terms if text.startswith(t, at)), key=len, default=None)
        out.append(terms[hit] if hit else text[at])
        at += len(hit) if hit else 1
    return "".join(out)


def test_every_document(spark):
    got = registry.QUERIES["lexicon_replaced_all"](spark, SF).count()
    assert got == table(spark, SF, "documents").count() > registry.QUERIES["lexicon_replaced"](spark, SF).count()


def test_overlaps(spark):
    rnd = random.Random(1)
    terms = {"der": "1", "and": "2", "ander": "3", "nde": "4", "the": "5", "hea": "6"}
    texts = ["ander under wander", "", *("".join(rnd.choice(["an", "d", "e", "r", "th", "ea", "n", " "]) for _ in range(60)) for _ in range(100))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", replace_terms(terms)("text")["text"].alias("r")).collect()
    assert all(r.r == brute(r.text, terms) for r in rows) and len(rows) == len(texts)


def test_hits_of_overlapping_terms():
    """Longest and shortest, against all matches sorted."""
    import ahocorasick

    from quirefold.operators.lexicon import _spans

    rnd = random.Random(2)
    for _ in range(300):
        terms = {"".join(rnd.choices("abé", k=rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 9))}
        text = "".join(rnd.choices("abé", k=rnd.randrange(60)))
        a = ahocorasick.Automaton()
        for t in terms:
            a.add_word(t, t)
        a.make_automaton()
        for sign in (-1, 1):
            want, at = [], 0
            for s, e, t in sorted(((i, i + len(t), t) for t in terms for i in range(len(text)) if text.startswith(t, i)), key=lambda x: (x[0], sign * x[1])):
                if s >= at:
                    want.append((s, e, t))
                    at = e
            assert list(_spans(a, text, max(map(len, terms)), sign < 0)) == want
