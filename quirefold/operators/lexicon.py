"""Dictionary replacement in text, and glossary use.

A dictionary is small by nature; its size is checked before it is sent to the
executors, and beyond ``BOUND`` terms the words are matched by an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from io import StringIO
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.pieces import arrow_udf
from quirefold.operators.ordered import spans_without_overlap

BOUND = 200_000
_HIT = pa.struct([("term", pa.string()), ("start", pa.int32())])


def collected(terms: DataFrame) -> dict[str, str]:
    rows = terms.select("src", "dst").limit(BOUND + 1).collect()
    if len(rows) > BOUND:
        raise ValueError(f"more than {BOUND} terms; use matched_words")
    return {r["src"]: r["dst"] for r in rows}


def _spans(a, text: str, widest: int, longest: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of the matches taken; of all others only those that begin in the last ``widest`` characters are held."""
    at, waiting = 0, []  # the automaton goes by the matches' ends

    def taken(before: int) -> Iterator[tuple[int, int, str]]:
        nonlocal at
        while waiting and waiting[0][0] < before:
            s, e, term = heappop(waiting)
            if s >= at:
                at = abs(e)
                yield s, at, term

    for last, term in a.iter(text):
        e = last + 1
        yield from taken(e - widest)  # no later match begins before that
        heappush(waiting, (e - len(term), -e if longest else e, term))
    yield from taken(len(text))


def replace_terms(terms: dict[str, str], match: str = "longest", hits: bool = True):
    """UDF text -> struct(text, hits): leftmost matches without overlap; at one start the longest (or shortest) wins.

    Without ``hits`` the struct has the text alone.
    """
    import ahocorasick

    def automaton():
        a = ahocorasick.Automaton()
        for src in terms:
            a.add_word(src, src)
        a.make_automaton()
        return a

    if len(terms) > BOUND:
        raise ValueError(f"more than {BOUND} terms; use phrases.hits")

    built = []  # by the worker, at its first piece
    widest = max(map(len, terms), default=0)

    def run(texts: pa.Array) -> pa.Array:
        if terms and not built:
            built.append(automaton())
        a = built[0] if built else None
        out, sizes, found_terms, starts = [], [0], [], []
        for t in texts.to_pylist():
            at, n, new = 0, 0, StringIO()
            for s, e, term in _spans(a, t, widest, match == "longest") if a and t else ():
                new.write(t[at:s])
                new.write(terms[term])
                if hits:
                    found_terms.append(term)
                    starts.append(s)
                at, n = e, n + 1
            if n:
                new.write(t[at:])
            out.append(new.getvalue() if n else t)
            sizes.append(n)
        replaced = pa.array(out, pa.string())
        if not hits:
            return pa.StructArray.from_arrays([replaced], names=["text"])
        found = pa.StructArray.from_arrays([pa.array(found_terms, pa.string()), pa.array(starts, pa.int32())], fields=list(_HIT))
        listed = pa.ListArray.from_arrays(pa.array(accumulate(sizes), pa.int32()), found)
        return pa.StructArray.from_arrays([replaced, listed], names=["text", "hits"])

    return arrow_udf(run, "struct<text:string,hits:array<struct<term:string,start:int>>>" if hits else "struct<text:string>")


def matched_words(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Single-word terms of any number, by an equi-join on lower-cased words."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text_col, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower))
    w = texts.select(id_col, F.explode(words).alias("word"))
    return w.join(terms.withColumn("word", F.lower("src")), "word").drop("word")


def relevant_terms(text: Column, terms: dict[str, str], cap: int = 32) -> Column:
    """Spans of the terms that occur, longest first and without overlap; Latin terms match whole words in any case."""

    def spans(term: str) -> Column:
        import re

        quoted = "".join("\\" + c if not c.isalnum() and c.isascii() and c != " " else c for c in term)
        pattern = rf"(?i)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if re.match("[A-Za-z]", term) else quoted
        gaps = F.split(text, pattern, -1)
        n = F.size(gaps) - 1
        before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda acc, g: acc + F.length(g)) + i * len(term)
        at = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), before)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda s: F.struct(s.alias("start"), (s + len(term)).alias("end"), F.lit(term).alias("term")))

    return spans_without_overlap(F.concat(*[spans(t) for t in terms]), cap)


def verify_and_fix(source: Column, translated: Column, terms: dict[str, str]) -> Column:
    """Translation with source terms left in it replaced, term by term; struct(text, fixed, missing).

    A fold over the terms as an array, so the plan does not grow with them.
    ``missing`` names the first ten terms whose translation is lacking and
    cannot be put in.
    """
    low = F.lower(source)
    listed = F.array(*[F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst")) for s, d in terms.items()]) if terms else F.array().cast("array<struct<src:string,dst:string>>")
    start = F.struct(translated.alias("text"), F.lit(0).alias("fixed"), F.array().cast("array<string>").alias("missing"))

    def step(acc: Column, t: Column) -> Column:
        lacks = F.contains(low, F.lower(t["src"])) & ~F.contains(acc["text"], t["dst"])
        fixable = F.contains(acc["text"], t["src"])
        return F.struct(
            F.when(lacks, F.replace(acc["text"], t["src"], t["dst"])).otherwise(acc["text"]).alias("text"),
            F.when(lacks & fixable, acc["fixed"] + 1).otherwise(acc["fixed"]).alias("fixed"),
            F.when(lacks & ~fixable & (F.size(acc["missing"]) < 10), F.concat(acc["missing"], F.array(F.concat(t["src"], F.lit("→"), t["dst"])))).otherwise(acc["missing"]).alias("missing"),
        )

    return F.aggregate(listed, start, step)
