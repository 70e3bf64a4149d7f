"""Secret scans with a randomness test battery, in DataFrame functions only.

Base patterns, leftmost and without overlaps per kind:

* assign: a key word (password, secret, token, api key; either case), a colon
  or equals sign and a value; kept if the value has 12 characters or more;
* access: AKIA and capital letters or digits, 18 characters or more;
* hex: 16 or more of [0-9a-f].

Candidates for the battery are runs of 20 or more of [A-Za-z0-9+/_-] with
digits, and letters beside them.  Each run's encoding is inferred from the
characters it holds - hex, base32, base36 or base64 (``-`` and ``_`` count as
``+`` and ``/``), by the smallest alphabet that holds them all - and its
characters become numbers in that alphabet:

* chi-squared of the character counts against a uniform alphabet, letter by
  letter (two-sided, as text repeats letters and counters never do) and in
  quarters of the alphabet (text keeps to one of them);
* runs above and below the alphabet's middle (Wald-Wolfowitz);
* serial correlation of neighbouring numbers.

A run is a secret if two things hold.  First, the battery does not tell it
from random characters: the least p-value, times the number of tests, is
``UNIFORM`` or more.  Second, it is told from text: each of its letters (case
and digits apart) weighs the logarithm of its frequency in text over that in a
uniform alphabet, and the chance that as many letters of text weigh as little
or less is the run's p-value.  Text is the words of ten letters or more of all
documents, of which names are made; without any, nothing is told from text.
Within each class of lengths Benjamini-Hochberg over all candidates of the
corpus controls the rate of text among the runs called secrets (``RATE``), on
p-values rounded up to a grid, so that the ranks come from a histogram of
bounded size.  Runs too short for their encoding thereby give no secrets.

All statistics are linear in a run's length.

Positions are code points, ends exclusive.  Null text: no spans.  Ties and
repeated rows: every row is judged on its own text; an empty table gives no
rows.  Extra columns are
carried along; those named as results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
#: Words whose letters stand for text: names are made of such.
WORDS = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{10,}(?![A-Za-z0-9+/_-])"

KINDS = ("assign", "access", "hex", "random")
#: False-discovery rate of text among secrets, and the least p-value at which a run may still be random.
RATE, UNIFORM = 0.05, 0.01
#: Matches whose places are added up at a time.
CHUNK = 512
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _class(alphabet: str) -> str:
    return "^[" + "".join("\\" + c if c in "-+/" else c for c in alphabet) + "]+$"


def _spans(text: Column, pattern: str, kind: int, fine=None) -> Column:
    """Array of (start, kind, end) of a pattern's matches.

    The lengths of the matches and of the texts between them add up to the
    places.  fine: which matches count, from the array of matches.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(
        hits, F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda h, g: F.struct(F.length(h).alias("hit"), F.length(g).alias("gap"))
    )
    # places within chunks of matches, then of the chunks, so that long texts with many matches stay cheap
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda i: F.slice(sizes, i * CHUNK + 1, F.lit(CHUNK)))
    ends = F.transform(
        chunks,
        lambda c: F.aggregate(
            c,
            F.array().cast("array<struct<gap:int,hit:int>>"),
            lambda acc, s: F.concat(
                acc,
                F.array(F.struct((s["gap"] + F.coalesce(F.get(acc, F.size(acc) - 1)["hit"], F.lit(0))).alias("gap"), (s["gap"] + s["hit"] + F.coalesce(F.get(acc, F.size(acc) - 1)["hit"], F.lit(0))).alias("hit"))),
            ),
        ),
    )
    before = F.aggregate(
        ends,
        F.array(F.lit(0)),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(c, -1)["hit"])),
    )
    found = F.flatten(
        F.zip_with(
            ends,
            F.slice(before, F.lit(1), F.size(ends)),
            lambda c, at: F.transform(c, lambda s: F.struct((at + s["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + s["hit"]).alias("end"))),
        )
    )
    if fine is not None:
        found = F.filter(F.zip_with(found, fine, lambda s, ok: F.when(ok, s)), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def _normal_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0, by formula 26.2.17 of Abramowitz and Stegun (fixed coefficients)."""
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2) / 2.5066282746310002 * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _normal_tail(F.abs(z)))


def _chi_tail(x: Column, df: int) -> Column:
    """P(chi-squared > x) by the cube-root transformation of Wilson and Hilferty."""
    z = (F.pow(F.greatest(x, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    return F.when(z >= 0, _normal_tail(z)).otherwise(1 - _normal_tail(-z))


def _canonical(t: Column) -> Column:
    return F.translate(t, "-_", "+/")


def _chars(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def text_weights(docs: DataFrame, text_col: str = "text") -> list[tuple[list[float], float, float]]:
    """For each alphabet its letters' weights (0 for what is no letter), and their mean and deviation in text."""
    words = docs.select(F.lower(F.array_join(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0)), "")).alias("w"))
    letters = ALPHABETS[3][1][10:]
    row = words.agg(*[F.sum(F.length("w") - F.length(F.replace("w", F.lit(c), F.lit("")))) for c in letters]).first()
    count = {c: 1 + (n or 0) for c, n in zip(letters, row, strict=True)}
    out = []
    for _, alphabet in ALPHABETS:
        mine = [c for c in alphabet if c.isalpha()]
        total = sum(count[c.lower()] for c in mine)
        share = {c: count[c.lower()] / total for c in mine}
        weight = {c: math.log(share[c] * len(mine)) for c in mine}
        mean = sum(share[c] * weight[c] for c in mine)
        spread = sum(share[c] * (weight[c] - mean) ** 2 for c in mine)
        out.append(([weight.get(c, 0.0) for c in alphabet], mean, math.sqrt(spread)))
    return out


def _battery(tokens: Column, weights: list[tuple[list[float], float, float]]) -> Column:
    """For each candidate (n, p, strength): its length, the battery's p-value, and -4 log2 of the chance that text weighs as little."""
    code = lambda t: F.coalesce(*[F.when(t.rlike(_class(a)), F.lit(i)) for i, (_, a) in enumerate(ALPHABETS)])
    pick = lambda values, s: F.element_at(F.array(*[F.lit(v) for v in values]), s["code"] + 1)
    is_letter = [[float(c.isalpha()) for c in a] for _, a in ALPHABETS]
    staged = F.transform(F.transform(tokens, _canonical), lambda t: F.struct(t.alias("t"), code(t).alias("code"), F.length(t).cast("double").alias("n")))
    staged = F.transform(
        staged,
        lambda s: F.struct(
            F.transform(_chars(s["t"]), lambda c: F.call_function("locate", c, pick([a for _, a in ALPHABETS], s)).cast("double")).alias("x"),
            F.transform(
                _chars(pick([a for _, a in ALPHABETS], s)), lambda c: s["n"] - F.length(F.replace(s["t"], c, F.lit(""))).cast("double")
            ).alias("c"),
            pick([float(len(a)) for _, a in ALPHABETS], s).alias("a"),
            s["n"].alias("n"),
            pick([w for w, _, _ in weights], s).alias("w"),
            pick(is_letter, s).alias("letter"),
            pick([m for _, m, _ in weights], s).alias("mean"),
            pick([d for _, _, d in weights], s).alias("deviation"),
        ),
    )
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y)

    def stats(s: Column) -> Column:
        x, a, n = (s[c] for c in ("x", "a", "n"))
        left, right = F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1)
        squares = total(F.transform(s["c"], lambda v: v * v))
        chi = squares * a / n - n
        quarter = (a / 4).cast("int")
        quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: total(F.slice(s["c"], i * quarter + 1, quarter)))
        middle = (a + 1) / 2
        turns = total(F.zip_with(left, right, lambda p, q: ((p > middle) != (q > middle)).cast("double")))
        lag = total(F.zip_with(left, right, lambda p, q: (p - middle) * (q - middle)))
        m = total(F.zip_with(s["c"], s["letter"], lambda c, y: c * y))
        weight = total(F.zip_with(s["c"], s["w"], lambda c, y: c * y))
        return F.struct(
            n.alias("n"),
            ((chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)).alias("z1"),
            ((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("z2"),
            (lag / ((a * a - 1) / 12 * F.sqrt(n - 1))).alias("z3"),
            (total(F.transform(quarters, lambda v: v * v)) * 4 / n - n).alias("q"),
            F.coalesce((m * s["mean"] - weight) / F.nullif(F.sqrt(m) * s["deviation"], F.lit(0.0)), F.lit(0.0)).alias("light"),
        )

    return F.transform(
        F.transform(staged, stats),
        lambda s: F.struct(
            s["n"].alias("n"),
            F.least(F.lit(1.0), 4 * F.least(_two_sided(s["z1"]), _two_sided(s["z2"]), _two_sided(s["z3"]), _chi_tail(s["q"], 3))).alias("p"),
            F.floor(-4 * F.log2(F.greatest(F.when(s["light"] >= 0, _normal_tail(s["light"])).otherwise(1.0), F.lit(1e-60)))).cast("int").alias("strength"),
        ),
    )


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def cuts(docs: DataFrame, weights: list[tuple[list[float], float, float]], text_col: str = "text") -> dict[int, int]:
    """Per class of lengths, the least strength at which runs are told from text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.where(text.rlike(RANDOM)).select(F.explode(_battery(F.regexp_extract_all(text, F.lit(RANDOM), F.lit(0)), weights)).alias("c"))
    cells = tokens.groupBy(_length_class(F.col("c.n")).alias("class"), F.col("c.strength").alias("strength")).agg(F.count("*").alias("m"))
    at_least = F.sum("m").over(Window.partitionBy("class").orderBy(F.desc("strength")))
    total = F.sum("m").over(Window.partitionBy("class"))
    told = F.pow(F.lit(2.0), -F.col("strength") / 4) <= RATE * at_least / total
    ok = cells.withColumn("ok", told).where("ok").groupBy("class").agg(F.min("strength").alias("cut"))
    return {r["class"]: r["cut"] for r in ok.collect()}  # a row a class: at most log2 of the longest run


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus base and spans: arrays of (start, kind, end) in order, kind being its place in KINDS."""
    docs = docs.drop("base", "spans", "_more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    long_value = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, long_value), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    weights = text_weights(docs, text_col)
    table = cuts(docs, weights, text_col)
    if not table:  # no run is told from text
        return docs.withColumn("base", base).withColumn("spans", F.col("base"))
    cut = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    secret = F.transform(
        _battery(F.regexp_extract_all(text, F.lit(RANDOM), F.lit(0)), weights),
        lambda c: (c["p"] >= UNIFORM) & F.coalesce(c["strength"] >= F.element_at(cut, _length_class(c["n"])), F.lit(False)),
    )
    rows = docs.withColumns({"base": base, "_more": _spans(text, RANDOM, 3, secret)})
    new = F.filter("_more", lambda r: ~F.exists("base", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    return rows.withColumn("spans", F.array_sort(F.concat("base", new))).drop("_more")


def listed(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark`` (overlapping spans by one)."""
    rows = scan(docs, text_col)
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col)))),
    )
    return rows.withColumn(text_col, F.when(F.size("spans") > 0, step).otherwise(F.col(text_col))).drop("base", "spans")
