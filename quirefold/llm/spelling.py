"""Spelling variants: words within one edit of a much more frequent word.

``word_counts`` adds words up in tasks before anything is shuffled.
``variants`` finds each word's near words (exactly one inserted, deleted or
replaced code point) with two minimal acyclic automata a block: a word walks
its first half exactly through the forward automaton and completes the rest
with one error, then its reversed last half through the backward one.  An
edit leaves one of the halves whole, so the two passes find every near word;
the backward pass leaves out what begins with the whole first half, which the
forward pass has.  A word's perfect-hash number in the automaton is the sum
of the words passed over on its way; counts are looked up by it.

Blocks: a word of length L asks under its first L // 2 code points and is a
candidate under the halves that words of length L - 1, L and L + 1 ask under
(at most two; the same backwards).  Spark deals blocks by (direction, half);
a task holds ``CHUNK`` rows and the rest of one block at a time.  In a block
of over ``BOUND`` rows the half that may err is cut place by place instead:
words that are equal but for that place meet, at most an alphabet of them.

Defined results:

* null and empty texts give no words; a null id counts as the empty text in
  the hash; repeated rows count again; other columns are ignored;
* among near words of equal count the smallest in code-point order wins;
* an empty table, or one without frequent words, gives no rows;
* texts are read in pieces of about a million characters, words of any
  length are words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize, release

RUN = re.compile("[a-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20
#: Different words that a task holds before it passes their counts on.
HELD = 200_000
#: Rows in one automaton, if no block is larger; and the largest block.
CHUNK = 20_000
BOUND = 50_000


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that cut no run of letters."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def word_counts(docs: DataFrame, least: int = 6, drop_every: int = 199) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``least`` code points or more.

    Where ``drop_every`` divides h, the CRC of ``<doc_id>:<run>``, the run's
    code point h % length is dropped before counting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                    start = zlib.crc32(f"{key}:".encode())
                    for piece in _pieces(text):
                        for word, n in Counter(RUN.findall(piece.encode().lower().decode())).items():
                            if len(word) < least:
                                continue
                            h = zlib.crc32(word.encode(), start)
                            if h % drop_every == 0:
                                i = h % len(word)
                                word = word[:i] + word[i + 1 :]
                                if len(word) < least:
                                    continue
                            held[word] += n
                        if len(held) > HELD:
                            yield out()
        if held:
            yield out()

    rows = docs.where("text <> ''").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """Minimal acyclic automaton of sorted, different words; a word's number is its rank among them."""

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, dict[str, tuple[int, int]]]] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                accepts, ways = open_.pop()
                open_[-1][1][last[len(open_) - 1]] = self._state(accepts[0], ways, known)

        for word in words:
            same = 0
            for a, b in zip(word, last):  # noqa: B905
                if a != b:
                    break
                same += 1
            close(same)
            open_ += [([False], {}) for _ in word[same:]]
            open_[-1][0][0] = True
            last = word
        close(0)
        self.root = self._state(open_[0][0][0], open_[0][1], known)

    def _state(self, accepts: bool, ways: dict[str, int], known: dict[tuple, int]) -> int:
        key = (accepts, *ways.items())
        at = known.get(key)
        if at is None:
            at = known[key] = len(self.states)
            passed, moves = int(accepts), {}
            for letter, state in ways.items():
                moves[letter] = (state, passed)
                passed += self._size[state]
            self.states.append((accepts, moves))
            self._size.append(passed)
        return at

    def _walk(self, state: int, number: int, word: str, at: int) -> int | None:
        """The number reached by word[at:] from a state, or None."""
        states = self.states
        for i in range(at, len(word)):
            move = states[state][1].get(word[i])
            if move is None:
                return None
            state = move[0]
            number += move[1]
        return number if states[state][0] else None

    def near(self, word: str, whole: int) -> set[int]:
        """Numbers of the words that begin with word[:whole] and differ from ``word`` by one edit after it."""
        state, number, found = self.root, 0, set()
        for i in range(whole):
            move = self.states[state][1].get(word[i])
            if move is None:
                return found
            state = move[0]
            number += move[1]
        for i in range(whole, len(word) + 1):
            here = word[i : i + 1]
            moves = self.states[state][1]
            if here and word[i + 1 : i + 2] != here:  # of equal letters in a row, dropping the last says it all
                found.add(self._walk(state, number, word, i + 1))
            for letter, (to, passed) in moves.items():
                if letter != here:  # of equal letters in a row, one more is found at their end
                    found.add(self._walk(to, number + passed, word, i))
                    if here:
                        found.add(self._walk(to, number + passed, word, i + 1))
            move = moves.get(here)
            if move is None:
                break
            state = move[0]
            number += move[1]
        found.discard(None)
        return found


_BLOCK = "backward boolean, half string, word string, n long, asks boolean"


def _blocks(words: DataFrame, least: int) -> DataFrame:
    """One row a word, direction and half (words reversed in the backward blocks)."""
    size = F.length("word")

    def halves(backward: bool) -> Column:
        half = lambda m: F.floor((m + int(backward)) / 2).cast("int")
        own = half(size)
        ways = F.array_distinct(F.filter(F.array(half(size - 1), own, half(size + 1)), lambda k: k >= F.lit(least // 2 if not backward else (least + 1) // 2)))
        w = F.reverse("word") if backward else F.col("word")
        return F.transform(ways, lambda k: F.struct(F.lit(backward).alias("backward"), F.left(w, k).alias("half"), w.alias("word"), (k == own).alias("asks")))

    rows = words.select("n", F.explode(F.concat(halves(False), halves(True))).alias("b"))
    return rows.select("b.backward", "b.half", "b.word", "n", "b.asks")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the asking rows; rows come sorted by block."""

    def solved(rows: list[tuple]) -> list[tuple]:
        out = []
        for backward in (False, True):
            counts = {w: n for b, _, w, n, _ in rows if b is backward}
            if not counts:
                continue
            words = sorted(counts)
            automaton = Automaton(words)
            for b, half, w, _, asks in rows:
                if b is not backward or not asks:
                    continue
                found = [(-counts[words[i]], words[i][::-1] if backward else words[i]) for i in automaton.near(w, len(half))]
                if backward:
                    w = w[::-1]
                    found = [x for x in found if not x[1].startswith(w[: len(w) // 2])]
                if found:
                    n, form = min(found)
                    out.append((w, len(found), -n, form))
        return out

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["word", "n_near", "form_n", "form"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if len(rows) >= CHUNK and row[:2] != rows[-1][:2]:
                yield batch_of(solved(rows))
                rows = []
            rows.append(row)
    yield batch_of(solved(rows))


def _by_place(rows: DataFrame) -> DataFrame:
    """The same for blocks too large for one automaton: words that are equal but for one place meet."""
    own = ["backward", "half", "word"]
    places = F.sequence(F.length("half") + 1, F.length("word"))
    cut = lambda i: F.concat(F.left("word", i - 1), F.substr("word", i + 1))
    cuts = rows.select(*own, "n", "asks", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), cut(i).alias("cut")))).alias("c")).select(*own, "n", "asks", "c.*")
    mine = lambda d, *more: d.where("asks").select("backward", "half", F.col("word").alias("asker"), *more)
    theirs = lambda d, *more: d.select("backward", "half", "word", "n", *more)
    replaced = mine(cuts, "place", "cut").join(theirs(cuts, "place", "cut"), ["backward", "half", "place", "cut"]).where("asker <> word")
    shorter = mine(cuts, F.col("cut").alias("word")).join(theirs(rows), ["backward", "half", "word"])
    longer = mine(rows).join(theirs(cuts, F.col("cut").alias("asker")), ["backward", "half", "asker"])
    names = ["backward", "asker", "word", "n"]
    pairs = replaced.select(*names).unionByName(shorter.select(*names)).unionByName(longer.select(*names)).distinct()
    turned = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select("backward", turned("asker").alias("word"), turned("word").alias("form"), "n")
    pairs = pairs.where("not backward or not startswith(form, left(word, length(word) div 2))")
    best = F.min(F.struct((-F.col("n")).alias("n"), "form"))
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def near_words(words: DataFrame, least: int = 6) -> DataFrame:
    """(word, n_near, form_n, form): the number of near words, and the most frequent one, of words that have any."""
    blocks = _blocks(words, least)
    key = ["backward", "half"]
    large = materialize(blocks.groupBy(*key).count().where(F.col("count") > BOUND).select(*key), "large_blocks")
    held = blocks
    found = None
    if not large.isEmpty():
        held = blocks.join(large, key, "left_anti")
        found = _by_place(blocks.join(large, key, "left_semi"))
    parts = held.select("backward", "half", "word", "n", "asks").repartition(*key).sortWithinPartitions(*key)
    near = parts.mapInArrow(_solve, "word string, n_near long, form_n long, form string")
    near = near if found is None else near.unionByName(found)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last one, each round over twice the way.

    Counts grow by the same factor at every step of the way, so it is as long
    as the logarithm of the largest count and the rounds are few.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        further = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        release(at)
        at = further


def variants(docs: DataFrame, least: int = 6, min_count: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least`` code points that occurs ``min_count`` times.

    ``form`` is the near word of largest count, if that is at least ``times``
    the word's; ``root`` the last one on the way along forms.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, or forms could lead in a circle")
    words = materialize(word_counts(docs, least).where(F.col("n") >= min_count), "words")
    near = near_words(words, least)
    known = F.col("form_n") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", F.when(known, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("form_n")).alias("form_n"))
    out = materialize(out, "forms")
    release(words)
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
