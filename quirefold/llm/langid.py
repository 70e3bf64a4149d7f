"""Language ID by interpolated Kneser-Ney character models.

For each language a bounded sample of labelled texts (``PER_LANG`` different
ones, the least by a hash of the text; copies count once) is counted into
character n-grams of its lower-cased words, up to ``ORDER`` characters, with a
blank before and after each word.  Kneser-Ney: the longest grams (and those that begin a word) keep
raw counts, shorter ones count the different characters before them; absolute
discounts n1 / (n1 + 2 n2) per order; every order is interpolated with the
next shorter one, the shortest with a uniform distribution.  The grams of all
languages lie in one sorted array of hashes per order, with a column of
log-probabilities for each language, and contexts with their back-off weights
likewise.

A document's language is the one with the lowest cross-entropy per character
over the whole text.  Each batch scores its distinct words once.

Score: the posterior of that language at ``EVIDENCE`` characters at most, so
that it stays informative on long texts.  Rejection is calibrated on
``HOLD_OUT`` of the sample, texts that the models don't see: a text is
rejected if its cross-entropy lies further above its language's mean than
twice the ``QUANTILE`` of the standardised excesses seen there (10 at least),
with a length-aware deviation sqrt(between + within / characters).  A language
with one text has nothing to hold out and rejects nothing.

Results: null text or a text without letters: ``und`` with score 0, rejected.
Nothing to learn from: every text is ``und``.  Labels, sources and ids are
never inputs of a prediction.  Languages of equal cross-entropy: the first by
name.  Repeated rows are judged one by one; an empty table gives no rows.  Extra columns are carried along; those named
as results are replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.arrays import Words, mix, word_slices

ORDER = 5
PER_LANG = 300
HOLD_OUT = 0.2
QUANTILE = 0.95
EVIDENCE = 40
#: Slices whose distinct words are scored together.
SLICES = 4
_SEED = np.uint64(0x9E3779B97F4A7C15)


def letters_of(word: str) -> str:
    """The word's letters in lower case."""
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def _hash(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in text:
        h = _step(h, np.array([ord(c)], np.uint64))
    return int(h[0])


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(h * _SEED + code + np.uint64(1))


def grams(words: Counter) -> Counter:
    """Grams of the longest order; shorter ones where a word begins."""
    out: Counter = Counter()
    for w, n in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            out[s[max(0, i - ORDER + 1) : i + 1]] += n
    return out


class KneserNey:
    """One language's interpolated model over grams, as a dict-based recursion used at build time."""

    def __init__(self, counts: Counter, alphabet: int):
        self.alphabet = alphabet
        levels: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for g, n in counts.items():
            levels[len(g)][g] += n
        for k in range(ORDER, 1, -1):
            for g in levels[k]:
                if not g[1:].startswith(" ") or len(g) == 2:
                    levels[k - 1][g[1:]] += 1
        self.levels = levels
        self.discount = []
        for level in levels:
            n1, n2 = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
            self.discount.append(n1 / (n1 + 2 * n2) if n1 else 0.0)
        self.total: dict[str, float] = defaultdict(float)
        self.kinds: dict[str, int] = defaultdict(int)
        for k in range(1, ORDER + 1):
            for g, n in levels[k].items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]] += 1
        self.seen: dict[str, float] = {}

    def weight(self, context: str) -> float:
        """What the shorter context gets; all of it for a context never seen."""
        total = self.total.get(context)
        return self.discount[len(context) + 1] * self.kinds[context] / total if total else 1.0

    def prob(self, gram: str) -> float:
        if not gram:
            return 1.0 / self.alphabet
        if gram not in self.seen:
            k, total = len(gram), self.total.get(gram[:-1])
            own = max(self.levels[k].get(gram, 0) - self.discount[k], 0.0) / total if total else 0.0
            shorter = self.prob(gram[1:]) if k > 1 else 1.0 / self.alphabet
            w = self.weight(gram[:-1])
            if total and not w:  # nothing was seen once: keep unseen grams possible
                own, w = own * (1 - 1e-4), 1e-4
            self.seen[gram] = own + w * shorter
        return self.seen[gram]


@dataclass
class Model:
    langs: list[str]
    gram_keys: list[np.ndarray]  # per order, sorted
    gram_logs: list[np.ndarray]  # log2 P, a column a language
    context_keys: list[np.ndarray]
    context_logs: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None
    between: np.ndarray | None = None
    within: np.ndarray | None = None
    limit: np.ndarray | None = None

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log2 P of each word (a column a language) and its number of predicted characters."""
        n = len(self.langs)
        size = np.array([len(t) for t in texts], np.int64)
        flat = " " + "  ".join(texts) + " "  # each word keeps a blank of its own on both sides
        code = np.frombuffer(flat.encode("utf-32-le"), np.uint32).astype(np.uint64)
        begin = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
        spread = np.repeat(begin, size + 1)
        step = np.arange(len(spread)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        at = spread + step + 1  # predicted character
        logs = np.zeros((len(at), n))
        open_ = np.ones(len(at), bool)
        for k in range(ORDER, 0, -1):
            rows = np.flatnonzero(open_ & (step + 2 >= k))
            if not len(rows):
                continue
            h = np.zeros(len(rows), np.uint64)
            for j in range(k - 1, 0, -1):
                h = _step(h, code[at[rows] - j])
            context, gram = h, _step(h, code[at[rows]])
            keys = self.gram_keys[k]
            where = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
            hit = keys[where] == gram if len(keys) else np.zeros(len(rows), bool)
            logs[rows[hit]] += self.gram_logs[k][where[hit]]
            open_[rows[hit]] = False
            miss = rows[~hit]
            keys = self.context_keys[k - 1]
            if len(miss) and len(keys):
                c = context[~hit]
                where = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                known = keys[where] == c
                logs[miss[known]] += self.context_logs[k - 1][where[known]]
        logs[open_] += self.floor
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        return (np.add.reduceat(logs, first, axis=0) if len(at) else np.zeros((0, n))), size + 1

    def judge(self, logs: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score and rejection of texts with letters."""
        h = -logs / chars[:, None]
        best = h.argmin(axis=1)
        gap = (h - h.min(axis=1, keepdims=True)) * np.minimum(chars, EVIDENCE)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        z = (h[np.arange(len(h)), best] - self.mean[best]) / np.sqrt(self.between[best] + self.within[best] / chars)
        return best, score, z > self.limit[best]


def build(sample: dict[str, list[Counter]]) -> Model | None:
    """Model of the sample's documents, given as word counts per language."""
    langs = sorted(lang for lang, docs in sample.items() if any(docs))
    if not langs:
        return None
    fit, held = {}, {}
    for lang in langs:
        docs = [d for d in sample[lang] if d]
        n = max(1, min(round(len(docs) * (1 - HOLD_OUT)), len(docs) - 1))
        fit[lang], held[lang] = docs[:n], docs[n:]
    counts = {lang: grams(sum(fit[lang], Counter())) for lang in langs}
    alphabet = len({c for g in counts.values() for x in g for c in x}) + 1
    models = [KneserNey(counts[lang], alphabet) for lang in langs]
    gram_keys, gram_logs, context_keys, context_logs = [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)))], [], []
    for k in range(1, ORDER + 1):
        known = sorted({g for m in models for g in m.levels[k]})
        keys = np.array([_hash(g) for g in known], np.uint64)
        logs = np.log2(np.array([[m.prob(g) for m in models] for g in known]).reshape(-1, len(langs)))
        order = np.argsort(keys)
        gram_keys.append(keys[order])
        gram_logs.append(logs[order])
        contexts = sorted({g[:-1] for g in known})
        keys = np.array([_hash(c) for c in contexts], np.uint64)
        logs = np.log2(np.maximum(np.array([[m.weight(c) for m in models] for c in contexts]).reshape(-1, len(langs)), 1e-4))
        order = np.argsort(keys)
        context_keys.append(keys[order])
        context_logs.append(logs[order])
    model = Model(langs, gram_keys, gram_logs, context_keys, context_logs, -math.log2(alphabet))
    stats = []
    for i, lang in enumerate(langs):
        h, n = [], []
        for words in held[lang]:
            logs, chars = model.words(list(words))
            times = np.array(list(words.values()))
            n.append(float((chars * times).sum()))
            h.append(-float((logs[:, i] * times).sum()) / n[-1])
        if not h:
            stats.append((0.0, 1.0, 1.0, np.inf))
            continue
        h, n = np.array(h), np.array(n)
        mean = np.average(h, weights=np.minimum(n, 2000))
        within = np.average((h - mean) ** 2 * n, weights=1 / n) + 1.0
        between = max(np.average((h - mean) ** 2, weights=n) - within / n.mean(), 0.0) + 0.01
        z = (h - mean) / np.sqrt(between + within / n)
        stats.append((mean, between, within, max(10.0, 2 * np.quantile(z, QUANTILE))))
    model.mean, model.between, model.within, model.limit = (np.array(x) for x in zip(*stats, strict=True))
    return model


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Model | None:
    """Fit on at most ``per_lang`` different labelled texts of each language, whole texts."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # the cut is found on hashes alone, one for all copies of a text; only the sample's texts are moved
    hashed = rows.withColumn("h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ends = hashed.select("lang", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).groupBy("lang").agg(F.max("h").alias("last"))
    near = hashed.join(F.broadcast(ends), "lang").where("h <= last")  # a row a language
    rows = near.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("rank", rank).select("lang", "text", "rank")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, rank, word, n = [], [], [], []
            for lang, r, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "rank", "text")), strict=True):
                c = Counter(filter(None, map(letters_of, text.split())))
                langs += [lang] * len(c)
                rank += [r] * len(c)
                word += c.keys()
                n += c.values()
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rank, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "rank", "word", "n"])

    found = rows.mapInArrow(counted, "lang string, rank int, word string, n long").toArrow()
    sample: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for lang, r, w, n in zip(*(found[c].to_pylist() for c in ("lang", "rank", "word", "n")), strict=True):
        sample[lang][r][w] += n
    return build({lang: [c for _, c in sorted(d.items())] for lang, d in sample.items()})


def _letters_at(slices: list[Words], places: np.ndarray) -> Iterator[str]:
    """Letters of the words at places of the slices laid end to end."""
    base = np.concatenate([[0], np.cumsum([len(w.starts) for w in slices])])
    data = [w.data.tobytes() for w in slices]
    which = np.searchsorted(base, places, side="right") - 1
    for k, at in zip(which.tolist(), (places - base[which]).tolist(), strict=True):
        yield letters_of(data[k][slices[k].starts[at] : slices[k].ends[at]].decode())


def _judged(model: Model, column: pa.Array) -> tuple[list, list, list]:
    """Predictions of a batch; the distinct words of ``SLICES`` slices are scored at once."""
    langs, scores, rejected = [], [], []
    slices = word_slices(column)
    while some_slices := list(islice(slices, SLICES)):
        _, first, back = np.unique(np.concatenate([w.hashes() for w in some_slices]), return_index=True, return_inverse=True)
        text = list(_letters_at(some_slices, first))
        lettered = np.array([bool(t) for t in text], bool)
        logs, chars = np.zeros((len(text), len(model.langs))), np.zeros(len(text))
        if lettered.any():
            logs[lettered], chars[lettered] = model.words([t for t in text if t])
        counts = np.concatenate([w.counts for w in some_slices])
        n, doc = len(counts), np.repeat(np.arange(len(counts)), counts)
        size = np.bincount(doc, weights=chars[back], minlength=n)
        total = np.stack([np.bincount(doc, weights=logs[back, i], minlength=n) for i in range(len(model.langs))], axis=1)
        some = size > 0
        best, score, out = np.full(n, -1), np.zeros(n), np.ones(n, bool)
        if some.any():
            best[some], score[some], out[some] = model.judge(total[some], size[some])
        langs += [model.langs[i] if i >= 0 else "und" for i in best.tolist()]
        scores += score.tolist()
        rejected += out.tolist()
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (0 to 1) and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b, c = _judged(shared.value, batch.column(text_col)) if shared.value else (["und"] * n, [0.0] * n, [True] * n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = docs.select("*").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)
