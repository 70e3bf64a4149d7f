"""Scans, projections and predicates on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.functions import quality, text
from quirefold.plans.base import LINES, PAIRS, Registry, forms, forms_sql, lines, pairs
from quirefold.session import table

R = Registry()


@R.add(
    "chunk_lines",
    rf"""WITH {LINES}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS sequence FROM lines WHERE trim(line) <> '')
SELECT doc_id, sequence, doc_id || '_' || printf('%04d', sequence) AS chunk_id, trim(line) AS text,
  len(regexp_extract_all(line, '\S+')) AS word_count, length(line) AS char_count FROM kept""",
)
def chunk_lines(spark, sf):
    """Chunk extraction, text form: non-blank lines numbered within the row."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(kept).alias("at", "line"))
    seq = (F.col("at") + 1).cast("long")
    return d.select(
        "doc_id",
        seq.alias("sequence"),
        F.concat_ws("_", F.col("doc_id").cast("string"), F.format_string("%04d", seq)).alias("chunk_id"),
        F.trim("line").alias("text"),
        F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("word_count"),
        F.length("line").cast("long").alias("char_count"),
    )


@R.add(
    "manifest",
    rf"""WITH {LINES} SELECT doc_id, lang, count(*) AS n_chunks, sum(length(line)) AS n_chars, sum(len(regexp_extract_all(line, '\S+'))) AS n_words
FROM lines WHERE trim(line) <> '' GROUP BY doc_id, lang""", big="n_chars n_words")
def manifest(spark, sf):
    """Manifest of a document: its chunks, characters and words, computed in the row."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    total = lambda f: F.aggregate(F.transform("kept", f), F.lit(0).cast("long"), lambda a, v: a + v)
    d = table(spark, sf, "documents").select("doc_id", "lang", kept.alias("kept")).where(F.size("kept") > 0)
    return d.select("doc_id", "lang", F.size("kept").cast("long").alias("n_chunks"), total(F.length).alias("n_chars"), total(lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("n_words"))


@R.add(
    "char_statistics",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]{2,}')) AS latin_words, len(regexp_extract_all(text, '[A-Za-z]')) AS latin_letters,
  len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) AS cjk_chars, greatest(1, length(text) // 2) AS tokens FROM documents""",
)
def char_statistics(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.latin_words(t).cast("long").alias("latin_words"),
        text.latin_letters(t).cast("long").alias("latin_letters"),
        text.cjk_chars(t).cast("long").alias("cjk_chars"),
        F.greatest(F.lit(1), F.floor(F.length(t) / 2)).cast("long").alias("tokens"),
    )


@R.add("number_tokens", r"""SELECT doc_id, unnest(regexp_extract_all(text, '\d+(?:[,.\-:/]\d+)*')) AS number FROM documents""")
def number_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.numbers(F.col("text"))).alias("number"))


_HTML_TEXT = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@R.add(
    "visible_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.visible_text(F.col("html")).alias("text"))


@R.add("tag_counts", r"""WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""")
def tag_counts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(text.tag_counts(F.col("html"))).alias("tag", "n")).withColumn("n", F.col("n").cast("long"))


@R.add("first_heading", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS heading FROM pages""")
def first_heading(spark, sf):
    h = F.regexp_extract("html", r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1)
    return table(spark, sf, "pages").select("page_id", text.squeeze(F.regexp_replace(h, "<[^>]+>", " ")).alias("heading"))


@R.add("heading_keys", rf"""WITH {LINES} SELECT DISTINCT regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '[\s:：.。]+$', '') AS heading FROM lines WHERE length(line) BETWEEN 1 AND 200""")
def heading_keys(spark, sf):
    return lines(spark, sf).where(F.length("line").between(1, 200)).select(text.heading_key(F.col("line")).alias("heading")).distinct()


@R.add("meaningful_headings", rf"""WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE length(trim(line)) BETWEEN 1 AND 200 AND regexp_matches(line, '[A-Za-z]') GROUP BY doc_id""")
def meaningful_headings(spark, sf):
    return lines(spark, sf).where(F.length(F.trim("line")).between(1, 200) & F.col("line").rlike("[A-Za-z]")).groupBy("doc_id").agg(F.count("*").alias("n"))


@R.add(
    "reference_notes",
    rf"""WITH {LINES}, s AS (SELECT doc_id, pos, line, regexp_matches(line, '(?i)https?://|www\.|doi\s*:|isbn\s*:') AS known,
  len(regexp_extract_all(line, '(?i)https?://|www\.|doi\s*:|isbn\s*:|(?:19|20)[0-9][0-9]')) AS signals, len(regexp_extract_all(line, '[.!?](?:\s|$)')) AS sentences FROM lines)
SELECT doc_id, pos FROM s WHERE trim(line) <> '' AND ((known AND length(line) <= 300 AND sentences <= 1) OR (signals >= 2 AND sentences <= 1))""",
)
def reference_notes(spark, sf):
    """Lines that only cite: skipped by chunking."""
    known = F.col("line").rlike(r"(?i)https?://|www\.|doi\s*:|isbn\s*:")
    signals = F.regexp_count("line", F.lit(r"(?i)https?://|www\.|doi\s*:|isbn\s*:|(?:19|20)[0-9][0-9]"))
    sentences = F.regexp_count("line", F.lit(r"[.!?](?:\s|$)"))
    skip = (known & (F.length("line") <= 300) & (sentences <= 1)) | ((signals >= 2) & (sentences <= 1))
    return lines(spark, sf).where((F.trim("line") != "") & skip).select("doc_id", "pos")


@R.add("translatable_nodes", rf"""WITH {LINES}, w AS (SELECT doc_id, line, regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]*') AS words FROM lines)
SELECT doc_id, count(*) AS n FROM w WHERE len(words) > 0 AND NOT (len(words) = 1 AND length(replace(words[1], '-', '')) <= 2)
  AND NOT (regexp_full_match(trim(line), '[A-Za-z0-9\s+\-*/=<>.,;:(){{}}\[\]^_|]+') AND len(list_filter(words, lambda x: length(replace(x, '-', '')) >= 3)) = 0)
GROUP BY doc_id""")
def translatable_nodes(spark, sf):
    """Text nodes worth translating: words, and no mere formula."""
    words = F.regexp_extract_all("line", F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0))
    size = lambda w: F.length(F.replace(w, F.lit("-"), F.lit("")))
    formula = F.trim("line").rlike(r"^[A-Za-z0-9\s+\-*/=<>.,;:(){}\[\]^_|]+$") & (F.size(F.filter(words, lambda w: size(w) >= 3)) == 0)
    short = (F.size(words) == 1) & (F.coalesce(size(F.get(words, F.lit(0))), F.lit(0)) <= 2)
    return lines(spark, sf).where((F.size(words) > 0) & ~short & ~formula).groupBy("doc_id").agg(F.count("*").alias("n"))


_KINDS = (
    ("nav", "nav|toc|contents|ncx"),
    ("copyright", "copyright|license|colophon|titlepage"),
    ("appendix", "appendix|appendices"),
    ("index", "index|glossary|bibliograph"),
    ("other", "cover|acknowledg|about|footnote|endnote"),
)


def chapter_kind(name):
    """Kind of a chapter by its file name: the first group with a hit."""
    out = None
    for kind, words in _KINDS:
        cond = F.lower(name).rlike(words)
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("body")


@R.add(
    "chapter_kinds",
    "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{w}') THEN '{k}'" for k, w in _KINDS) + " ELSE 'body' END AS kind FROM pages",
)
def chapter_kinds(spark, sf):
    return table(spark, sf, "pages").select("page_id", chapter_kind(F.col("url")).alias("kind"))


@R.add(
    "chapter_kind_by_heading",
    rf"""WITH {LINES}, h AS (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(arg_min(line, pos), '\s+', ' ', 'g'))), '[\s:：.。]+$', '') AS heading FROM lines WHERE trim(line) <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN heading IN ('index', 'bibliography', 'references', 'sources', 'works cited') THEN 'index' WHEN regexp_full_match(heading, '(photo|picture|image|illustration) credits') THEN 'other' ELSE 'body' END AS kind FROM h""",
)
def chapter_kind_by_heading(spark, sf):
    first = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1)
    d = table(spark, sf, "documents").where(F.exists(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    h = text.heading_key(first)
    kind = F.when(h.isin("index", "bibliography", "references", "sources", "works cited"), "index").when(h.rlike("^(photo|picture|image|illustration) credits$"), "other")
    return d.select("doc_id", kind.otherwise("body").alias("kind"))


@R.add("chunk_hashes", r"""SELECT doc_id, sha256(text) AS source_hash, left(sha1(text), 12) AS short_hash, sha256('zh@v1@' || lang || '@t0.00@' || text) AS cache_key FROM documents""")
def chunk_hashes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.sha2(t, 256).alias("source_hash"), F.left(F.sha1(t), F.lit(12)).alias("short_hash"), F.sha2(F.concat(F.lit("zh@v1@"), F.col("lang"), F.lit("@t0.00@"), t), 256).alias("cache_key")
    )


@R.add("deterministic_sample", r"""SELECT doc_id FROM documents WHERE CAST('0x' || left(sha1(text), 8) AS BIGINT) / 4294967295.0 < 0.15""")
def deterministic_sample(spark, sf):
    return table(spark, sf, "documents").where(quality.sampled(F.col("text"), 0.15)).select("doc_id")


@R.add("previews", r"""SELECT doc_id, CASE WHEN length(text) > 80 THEN rtrim(left(text, 77)) || '...' ELSE text END AS preview FROM documents""")
def previews(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.short(F.col("text"), 80).alias("preview"))


_AUDIT = r"""WITH {pairs}, n AS (SELECT *, CASE WHEN length(src) = 0 THEN 1.0 ELSE round_even(length(dst) / length(src), 3) END AS ratio,
  len(regexp_extract_all(src, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS wa, len(regexp_extract_all(dst, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS wb,
  len(regexp_extract_all(src, '[A-Za-z]')) AS la, len(regexp_extract_all(dst, '[A-Za-z]')) AS lb, len(regexp_extract_all(dst, '[\x{{3400}}-\x{{9fff}}]')) AS cb,
  lower(trim(regexp_replace(src, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(dst, '\s+', ' ', 'g'))) AS same,
  regexp_extract_all(src, '\d+(?:[,.\-:/]\d+)*') AS na, regexp_extract_all(dst, '\d+(?:[,.\-:/]\d+)*') AS nb FROM pairs),
m AS (SELECT *, (wb >= greatest(6, floor(wa * 0.7)) AND cb < greatest(6, floor(lb * 0.15))) OR (cb > 0 AND wb >= 12 AND lb > greatest(120.0, cb * 2.5)) AS rest,
  list_filter(list_distinct(na), lambda x: len(list_filter(na, lambda y: y = x)) > len(list_filter(nb, lambda y: y = x))) AS gone,
  regexp_matches(lower(dst), 'error:|rate limit|cannot translate|can''t translate|unable to process|i''m unable|i am unable|sorry,') AS err FROM n),
f AS (SELECT *, list_filter([CASE WHEN dst = '' THEN 'empty_translation' END,
  CASE WHEN dst <> '' AND ((same AND wa >= 2 AND la >= 12) OR (wa >= 6 AND rest)) THEN 'likely_untranslated' END,
  CASE WHEN err THEN 'error_like_response' END,
  CASE WHEN length(src) >= 40 AND length(dst) > 0 AND ratio < 0.25 THEN 'suspiciously_short_translation' END,
  CASE WHEN len(gone) > 0 THEN 'numbers_missing' END], lambda x: x IS NOT NULL) AS flags FROM m)"""


@R.add(
    "translation_audit",
    _AUDIT.format(pairs=PAIRS)
    + " SELECT item_id, ratio, array_to_string(flags, ',') AS flags, CASE WHEN list_has_any(flags, ['empty_translation', 'likely_untranslated', 'error_like_response']) THEN 'fail' WHEN len(flags) > 0 THEN 'warn' ELSE 'ok' END AS risk_level FROM f",
)
def translation_audit(spark, sf):
    a, b = F.col("src"), F.col("dst")
    p = pairs(spark, sf).withColumn("audit", quality.audit(a, b))
    return p.select("item_id", quality.length_ratio(a, b).alias("ratio"), F.array_join("audit.flags", ",").alias("flags"), F.col("audit.risk_level").alias("risk_level"))


@R.add(
    "audit_summary",
    _AUDIT.format(pairs=PAIRS)
    + " SELECT unnest(flags) AS flag, count(*) AS n FROM f GROUP BY 1",
)
def audit_summary(spark, sf):
    p = pairs(spark, sf).select(F.explode(quality.audit(F.col("src"), F.col("dst"))["flags"]).alias("flag"))
    return p.groupBy("flag").agg(F.count("*").alias("n"))


@R.add(
    "numbers_missing",
    rf"""WITH {PAIRS}, a AS (SELECT item_id, unnest(regexp_extract_all(src, '\d+(?:[,.\-:/]\d+)*')) AS number FROM pairs), b AS (SELECT item_id, unnest(regexp_extract_all(dst, '\d+(?:[,.\-:/]\d+)*')) AS number FROM pairs)
SELECT item_id, number, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY item_id, number""",
)
def numbers_missing(spark, sf):
    """Multiset difference of number tokens, per pair and without a shuffle of texts."""
    p = pairs(spark, sf).select("item_id", F.explode(quality.missing_numbers(F.col("src"), F.col("dst"))).alias("number"))
    return p.groupBy("item_id", "number").agg(F.count("*").alias("n"))


@R.add(
    "review_reasons",
    rf"""WITH {PAIRS}, n AS (SELECT *, length(dst) / greatest(1, length(src)) AS ratio, lower(' ' || src || ' ') AS padded,
  len(regexp_extract_all(src, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS wa, len(regexp_extract_all(dst, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS wb, len(regexp_extract_all(dst, '[A-Za-z]')) AS lb,
  lower(trim(regexp_replace(src, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(dst, '\s+', ' ', 'g'))) AS same FROM pairs)
SELECT item_id, array_to_string(list_filter([CASE WHEN length(src) >= 420 THEN 'long_text' END,
  CASE WHEN regexp_extract_all(src, '\d+(?:[,.\-:/]\d+)*') <> regexp_extract_all(dst, '\d+(?:[,.\-:/]\d+)*') THEN 'number_mismatch' END,
  CASE WHEN regexp_matches(padded, ' (not|never|unless|although|though|however|but|because|therefore|despite|rather than) ') THEN 'logic_relation' END,
  CASE WHEN ratio < 0.32 OR ratio > 2.4 THEN 'length_ratio' END,
  CASE WHEN regexp_matches(lower(dst), 'sorry,|unable to process') OR (src <> '' AND dst <> '' AND wa >= 6 AND (same OR (wb >= greatest(6, floor(wa * 0.7))))) THEN 'translation_suspect' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n""",
)
def review_reasons(spark, sf):
    return pairs(spark, sf).select("item_id", F.array_join(quality.review_reasons(F.col("src"), F.col("dst")), ",").alias("reasons"))


@R.add(
    "residual_categories",
    rf"""WITH {LINES}, n AS (SELECT doc_id, len(regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS w, len(regexp_extract_all(line, '[A-Za-z]')) AS l, pos FROM lines),
c AS (SELECT CASE WHEN pos = 1 AND w >= 2 AND l >= 12 THEN 'short_english_title' WHEN w >= 10 AND l >= 80 THEN 'long_english_no_cjk' WHEN w >= 12 AND l >= 120 THEN 'likely_untranslated' ELSE '' END AS category FROM n)
SELECT category, count(*) AS n FROM c GROUP BY category""",
)
def residual_categories(spark, sf):
    c = quality.residual_category(F.col("line"), F.col("pos") == 1)
    return lines(spark, sf).select(c.alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@R.add(
    "artifact_audit",
    rf"""WITH {LINES}, n AS (SELECT doc_id, len(regexp_extract_all(line, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS w, len(regexp_extract_all(line, '[A-Za-z]')) AS l FROM lines WHERE trim(line) <> '')
SELECT doc_id, count(*) AS checked, count_if(w >= 10 AND l >= 80) AS residual, CASE WHEN count_if(w >= 10 AND l >= 80) > 0 THEN 'failed' ELSE 'passed' END AS status FROM n GROUP BY doc_id""", big="residual")
def artifact_audit(spark, sf):
    """Per document: blocks checked, and blocks still in the source language."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    bad = F.size(F.filter("kept", lambda x: quality.residual_category(x, F.lit(False)) != "")).cast("long")
    d = table(spark, sf, "documents").select("doc_id", kept.alias("kept")).where(F.size("kept") > 0)
    return d.select("doc_id", F.size("kept").cast("long").alias("checked"), bad.alias("residual"), F.when(bad > 0, "failed").otherwise("passed").alias("status"))


# Words that open sentences, and short generic words, none of them names.
STOP_WORDS = """The This That These Those There Their They Them And But Or Nor So Yet For Of In On At By To From With Without About Above Below
Under Over After Before When While Where Why How What Who Whom Which Whose Here Now Then Today Tomorrow Yesterday Yes No Maybe Perhaps Indeed Even
Only Just Still Already Always Never Often Sometimes Usually Once Twice He She It We You I Me My Mine Your Yours His Her Hers Its Our Ours Will
Would Could Should Might Must Shall Can May Do Did Does Done Be Been Being Am Is Are Was Were Have Has Had Get Got Make Made Take Took Come Came Go
Went Said Say Chapter Part Book Section Page Volume""".split()
# Titles before names.
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Professor Sir Lord Lady Captain Colonel Major General Sergeant Lieutenant King Queen Prince Princess Duke Duchess Father Brother Sister Uncle Aunt Saint St".split()

_RUN = r"[A-Z][a-z''’\-]+(?:\s+[A-Z][a-z''’\-]+){0,2}"
_BLOCK = ", ".join(f"'{w}'" for w in sorted({*STOP_WORDS, *HONORIFICS}))


def term_candidates(docs, id_col="doc_id", text_col="text", min_count=2):
    """Candidate terms with counts, first-in-sentence counts and confidence.

    Runs of capitalised words, runs after a title (again, as such) and
    acronyms; counts are pre-aggregated by Spark before the shuffle.
    """
    t = F.col(text_col)
    run = r"[A-Z][a-z'’\-]+(?:\s+[A-Z][a-z'’\-]+){0,2}"
    titles = "|".join(HONORIFICS)
    found = [
        (F.regexp_extract_all(t, F.lit(rf"(?:^|[^A-Za-z])({run})"), F.lit(1)), "capitalized"),
        (F.regexp_extract_all(t, F.lit(rf"(?:^|[^A-Za-z])(?:{titles})\.?\s+({run})"), F.lit(1)), "honorific"),
        (F.regexp_extract_all(t, F.lit(r"(?:^|[^A-Za-z])([A-Z]{2,6})(?:[^A-Za-z]|$)"), F.lit(1)), "acronym"),
        (F.regexp_extract_all(t, F.lit(r"(?:^|[.!?]\s+|\n)([A-Z][a-z'’\-]+)"), F.lit(1)), "initial"),
    ]

    def marked(hits, kind):
        return F.transform(hits, lambda h: F.struct(text.term_key(h).alias("term"), F.lit(kind).alias("kind")))

    each = F.concat(*[marked(*x) for x in found])
    hits = docs.select(F.explode(each).alias("h")).select("h.term", "h.kind")
    is_kind = lambda k: F.col("kind") == k
    counts = hits.groupBy("term").agg(
        F.count_if(~is_kind("initial")).alias("count"),
        F.count_if(is_kind("initial")).alias("initial"),
        F.bool_or(is_kind("honorific")).alias("honorific"),
        F.bool_or(is_kind("acronym")).alias("acronym"),
    )
    ok = (F.col("count") >= min_count) & ~F.col("term").isin(*STOP_WORDS, *HONORIFICS) & ((F.col("initial") < F.col("count")) | F.col("honorific"))
    confidence = F.when(F.col("honorific"), 0.9).when(F.col("acronym"), 0.7).otherwise(0.5)
    return counts.where(ok & F.length("term").between(2, 60)).select("term", "count", "initial", confidence.alias("confidence"))


_TITLES = "|".join(HONORIFICS)
_CANDIDATES = rf"""hits AS (
  SELECT regexp_replace(trim(regexp_replace(term, '\s+', ' ', 'g')), '[''’]s$', '') AS term, kind FROM (
    SELECT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])({_RUN})', 1)) AS term, 'capitalized' AS kind FROM documents
    UNION ALL SELECT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])(?:{_TITLES})\.?\s+({_RUN})', 1)), 'honorific' FROM documents
    UNION ALL SELECT unnest(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z]{{2,6}})(?:[^A-Za-z]|$)', 1)), 'acronym' FROM documents
    UNION ALL SELECT unnest(regexp_extract_all(text, '(?:^|[.!?]\s+|\n)([A-Z][a-z''’\-]+)', 1)), 'initial' FROM documents)),
counts AS (SELECT term, count_if(kind <> 'initial') AS "count", count_if(kind = 'initial') AS initial, bool_or(kind = 'honorific') AS honorific, bool_or(kind = 'acronym') AS acronym FROM hits GROUP BY term),
candidates AS (SELECT term, "count", initial, CAST(CASE WHEN honorific THEN 0.9 WHEN acronym THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM counts
  WHERE "count" >= 2 AND term NOT IN ({_BLOCK}) AND (initial < "count" OR honorific) AND length(term) BETWEEN 2 AND 60)"""


@R.add("term_candidates", f"WITH {_CANDIDATES} SELECT * FROM candidates", big="count initial")
def term_candidate_counts(spark, sf):
    return term_candidates(table(spark, sf, "documents"))


@R.add("top_candidates", f'WITH {_CANDIDATES} SELECT term, "count", confidence FROM candidates ORDER BY confidence DESC, "count" DESC, term LIMIT 200', big="count")
def top_candidates(spark, sf):
    return term_candidates(table(spark, sf, "documents")).orderBy(F.desc("confidence"), F.desc("count"), "term").limit(200).select("term", "count", "confidence")


@R.add("extraction_stats", f"WITH {_CANDIDATES} SELECT count(*) AS kept, CAST(sum(\"count\") AS BIGINT) AS mentions FROM candidates")
def extraction_stats(spark, sf):
    return term_candidates(table(spark, sf, "documents")).agg(F.count("*").alias("kept"), F.sum("count").alias("mentions"))


# Forms that the tables lack, one of them for each page, with its title or number inside.

_CSS = [(1, "p{writing-mode: vertical-rl;color:red} /* {t} */"), (2, "p.n{n}{-webkit-writing-mode:VERTICAL-LR; direction: rtl}"), (3, "h1{text-orientation: upright} /* {t} */"), (4, "b{writing-mode: horizontal-tb;}")]


@R.add(
    "horizontal_css",
    rf"""SELECT id, regexp_replace(regexp_replace(regexp_replace(css, '(?i)(-webkit-|-epub-)?writing-mode\s*:\s*vertical-(?:lr|rl)\s*;?', '\1writing-mode: horizontal-tb;', 'g'),
  '(?i)text-orientation\s*:\s*upright\s*;?', 'text-orientation: mixed;', 'g'), '(?i)direction\s*:\s*rtl\s*;?', 'direction: ltr;', 'g') AS css FROM {forms_sql(_CSS, "id, css")}""",
)
def horizontal_css(spark, sf):
    return forms(spark, sf, _CSS, "id int, css string").select("id", text.horizontal_css(F.col("css")).alias("css"))


_MARKS = [(1, "﹁天{n}︐地{t}﹂"), (2, "︵{t}︶︽b︾︖"), (3, "{t}")]


@R.add("upright_punctuation", f"SELECT id, translate(t, '{text.VERTICAL_MARKS}', '{text.UPRIGHT_MARKS}') AS t FROM {forms_sql(_MARKS, 'id, t')}")
def upright_punctuation(spark, sf):
    return forms(spark, sf, _MARKS, "id int, t string").select("id", text.upright_punctuation(F.col("t")).alias("t"))


_STYLES = [(1, "font-family: {t}; color: red"), (2, "line-height: {n}px;"), (3, "background-color: #fff; line-height: 1.{n}"), (4, "")]


@R.add(
    "clean_styles",
    rf"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(s, '(?i)font-family\s*:[^;]+;?', '', 'g'), '(?i)line-height\s*:\s*\d+px;?', '', 'g'), '(?i)background-color\s*:[^;]+;?', '', 'g')) AS s FROM {forms_sql(_STYLES, "id, s")}""",
)
def clean_styles(spark, sf):
    return forms(spark, sf, _STYLES, "id int, s string").select("id", text.clean_style(F.col("s")).alias("s"))


@R.add(
    "typography",
    r"""WITH p AS (SELECT page_id, string_split(html, '<') AS x FROM pages), t AS (
  SELECT page_id, x, list_transform(x, lambda s: regexp_extract(s, '(?s)^(.*>)?([^>]*)$', 1)) AS heads, list_transform(x, lambda s: regexp_replace(regexp_extract(s, '(?s)^(.*>)?([^>]*)$', 2), '\.{3,}', '…', 'g')) AS tails FROM p
)
SELECT page_id, array_to_string(list_transform(x, lambda s, i: CASE WHEN i = len(x) THEN s
  ELSE heads[i] || regexp_replace(regexp_replace(tails[i], '(^|[^:/\-])--($|[^\-/>])', '\1—\2', 'g'), '(^|[^:/\-])--($|[^\-/>])', '\1—\2', 'g') END), '<') AS html FROM t""",
)
def typography(spark, sf):
    """Ellipses and dashes in the texts of all pages."""
    return table(spark, sf, "pages").select("page_id", text.typography(F.col("html")).alias("html"))


_NAMES = [(1, "C:\\x\\my:{t}?.epub"), (2, "/tmp/..{t}.txt"), (3, ""), (4, "a" * 150 + "{n}.epub"), (5, "no extension {t}"), (6, "書 名{n}.epub")]


@R.add(
    "safe_names",
    rf"""WITH b AS (SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(list_extract(regexp_split_to_array(name, '[/\\]'), -1), '[<>:"|?*]', '_', 'g')), '^\.+', ''), '\s+', ' ', 'g')) AS n FROM {forms_sql(_NAMES, "id, name")})
SELECT id, CASE WHEN n = '' THEN 'upload.bin' WHEN contains(n, '.') THEN rtrim(left(regexp_extract(n, '^(.*)\.([^.]*)$', 1), 120)) || '.' || regexp_extract(n, '^(.*)\.([^.]*)$', 2) ELSE rtrim(left(n, 120)) END AS name FROM b""",
)
def safe_names(spark, sf):
    return forms(spark, sf, _NAMES, "id int, name string").select("id", text.safe_name(F.col("name")).alias("name"))


_HREFS = [(1, "./text/a%20{n}.xhtml#c1"), (2, "../x{n}.html"), (3, "y{n}.html#"), (4, "#top{n}")]


@R.add(
    "href_parts",
    f"WITH u AS (SELECT id, url_decode(h) AS h FROM {forms_sql(_HREFS, 'id, h')}) SELECT id, regexp_replace(split_part(h, '#', 1), '^[./]+', '') AS file, CASE WHEN contains(h, '#') THEN regexp_extract(h, '#(.*)$', 1) ELSE '' END AS fragment FROM u",
)
def href_parts(spark, sf):
    return forms(spark, sf, _HREFS, "id int, h string").select("id", text.href_parts(F.col("h")).alias("p")).select("id", "p.file", "p.fragment")


@R.add(
    "page_href_parts",
    r"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)
SELECT page_id, h, regexp_replace(split_part(url_decode(h), '#', 1), '^[./]+', '') AS file, CASE WHEN contains(url_decode(h), '#') THEN regexp_extract(url_decode(h), '#(.*)$', 1) ELSE '' END AS fragment FROM u""",
)
def page_href_parts(spark, sf):
    """Parts of every href of the pages."""
    h = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return h.select("page_id", "h", text.href_parts(F.col("h")).alias("p")).select("page_id", "h", "p.file", "p.fragment")


_NOTES = [(1, '<a href="part0062.html#ch{n}fn1">1</a> {t}'), (2, '<a href="x.html#n1">{t}'), (3, None)]


@R.add(
    "footnote_references",
    rf"""SELECT id, nullif(regexp_extract(h, 'href=["'']([^"'']+?\.x?html#(ch(\d+)fn(\d+)))["'']', 2), '') AS anchor, TRY_CAST(regexp_extract(h, 'href=["'']([^"'']+?\.x?html#(ch(\d+)fn(\d+)))["'']', 3) AS INTEGER) AS chapter FROM {forms_sql(_NOTES, "id, h")}""",
)
def footnote_references(spark, sf):
    return forms(spark, sf, _NOTES, "id int, h string").select("id", text.footnote(F.col("h")).alias("f")).select("id", "f.anchor", "f.chapter")


_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|::1"


@R.add("masked_ips", rf"WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_IP}')) AS ip FROM documents) SELECT doc_id, ip AS found, CASE WHEN list_bool_and(list_transform(string_split(ip, '.'), lambda x: len(string_split(ip, '.')) = 4 AND TRY_CAST(x AS INTEGER) <= 255 AND CAST(TRY_CAST(x AS INTEGER) AS VARCHAR) = x)) THEN regexp_replace(ip, '\.[0-9]+$', '.0') ELSE '' END AS ip FROM d")
def masked_ips(spark, sf):
    """Addresses met in all documents, with the last part zeroed; what is none is blank."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_IP})"), F.lit(1))).alias("found"))
    return d.select("doc_id", "found", text.masked_ip(F.col("found")).alias("ip"))


@R.add(
    "tag_deltas",
    r"""WITH t AS (SELECT page_id, html AS a, replace(replace(replace(html, '<b>', '<em>'), '<br>', ''), '<p>', '<p><i>') AS b FROM pages), x AS (SELECT page_id, tag, sum(s) AS source, sum(d) AS translated FROM (
  SELECT page_id, lower(unnest(regexp_extract_all(a, '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag, 1 AS s, 0 AS d FROM t UNION ALL SELECT page_id, lower(unnest(regexp_extract_all(b, '<([A-Za-z][A-Za-z0-9]*)', 1))), 0, 1 FROM t) GROUP BY page_id, tag)
SELECT page_id, tag, CAST(source AS BIGINT) AS source, CAST(translated AS BIGINT) AS translated FROM x WHERE source <> translated""",
)
def tag_deltas(spark, sf):
    """Tags whose counts an edit of each page changes, with both counts."""
    p = table(spark, sf, "pages")
    b = F.replace(F.replace(F.replace("html", F.lit("<b>"), F.lit("<em>")), F.lit("<br>"), F.lit("")), F.lit("<p>"), F.lit("<p><i>"))
    # outer: explode would have a filter on the map's size, which computes it a second time
    d = p.select("page_id", F.explode_outer(text.tag_delta(F.col("html"), b)).alias("tag", "v")).where("tag is not null")
    return d.select("page_id", "tag", F.col("v.source").cast("long").alias("source"), F.col("v.translated").cast("long").alias("translated"))


_GLOSSARY_TEXT = [(1, "Smith=史密斯{n}\nLondon: 倫敦\nbad line\n=x\nSmith=史密斯二"), (2, "{t}={n}\n{t} : x\n\n a : b=c ")]


@R.add(
    "glossary_text",
    rf"""WITH l AS (SELECT id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM {forms_sql(_GLOSSARY_TEXT, "id, t")}),
p AS (SELECT id, n, trim(regexp_extract(line, '^([^=:]*)[=:](.*)$', 1)) AS src, trim(regexp_extract(line, '^([^=:]*)[=:](.*)$', 2)) AS dst FROM l)
SELECT id, src, arg_max(dst, n) AS dst FROM p WHERE src <> '' AND dst <> '' GROUP BY id, src""",
)
def glossary_text(spark, sf):
    """One term a line, split at the first = or :; the last line of a term wins."""
    pattern = r"^([^=:]*)[=:](.*)$"
    d = forms(spark, sf, _GLOSSARY_TEXT, "id int, t string").select("id", F.posexplode(F.split("t", "\n")).alias("n", "line"))
    d = d.select("id", "n", F.trim(F.regexp_extract("line", pattern, 1)).alias("src"), F.trim(F.regexp_extract("line", pattern, 2)).alias("dst"))
    return d.where("src <> '' and dst <> ''").groupBy("id", "src").agg(F.max_by("dst", "n").alias("dst"))


_TIMINGS = [(1, "TranslateMap: 1{n} ms\nGlossary: 2000 ms\nTotal: 20{n} ms"), (2, "Preprocess: 1{n} ms\nReduce: 500 ms")]


@R.add(
    "stage_timings",
    rf"""WITH l AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM {forms_sql(_TIMINGS, "id, t")}), p AS (SELECT id, regexp_extract(line, '^(\w+):\s*(\d+)\s*ms', 1) AS stage, TRY_CAST(regexp_extract(line, '^(\w+):\s*(\d+)\s*ms', 2) AS BIGINT) AS ms FROM l)
SELECT id, CAST(coalesce(max(ms) FILTER (stage = 'Total'), sum(ms)) AS BIGINT) AS total_ms, CAST(coalesce(sum(ms) FILTER (stage IN ('TranslateMap', 'BookTitle', 'Glossary')), 0) AS BIGINT) AS model_ms FROM p GROUP BY id""",
)
def stage_timings(spark, sf):
    """Stage times in a text report: an explicit total wins over the sum."""
    d = forms(spark, sf, _TIMINGS, "id int, t string").select("id", F.explode(F.split("t", "\n")).alias("line"))
    pattern = r"^(\w+):\s*(\d+)\s*ms"
    d = d.select("id", F.regexp_extract("line", pattern, 1).alias("stage"), F.expr(rf"try_cast(regexp_extract(line, r'{pattern}', 2) as long)").alias("ms"))
    total = F.coalesce(F.max(F.when(F.col("stage") == "Total", F.col("ms"))), F.sum("ms"))
    model = F.coalesce(F.sum(F.when(F.col("stage").isin("TranslateMap", "BookTitle", "Glossary"), F.col("ms"))), F.lit(0))
    return d.groupBy("id").agg(total.alias("total_ms"), model.cast("long").alias("model_ms"))
