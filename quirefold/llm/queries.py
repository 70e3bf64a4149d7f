"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import table


def op2_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document after repeated 35-word windows are removed; nulls, ties and empty tables as in rlz_dedup."""
    from quirefold.llm.rlz_dedup import rlz_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rlz_dedup(docs).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op5_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and representative of each document over two-word shingles; nulls, ties and empty tables as in setsketch."""
    from quirefold.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later places of repeated 50-word passages; nulls, ties and empty tables as in suffix_dedup."""
    from quirefold.llm.suffix_dedup import suffix_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return suffix_dedup(docs).select(
        "doc_id", "n_words", removed.alias("n_removed"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 tokens; nulls, repeated rows and empty tables as in packing."""
    from quirefold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2048, end_id=0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of each document; nulls, repeated rows and empty tables as in bpe."""
    from quirefold.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _remainder(n: int):
    """crc32 of the id as text (a null id: of the empty text) modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op7_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, learned from two thirds of them; null and letterless texts are und."""
    from quirefold.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model = learn(docs.where(~held_out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of each document under the model and under the base; a null text is the end token alone."""
    from quirefold.llm.suffix_tree_lm import fit_and_score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fit_and_score(docs, _remainder(7) != 2).select(
        "doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth one; nulls, ties, lengths and empty tables as in voronoi_knn."""
    from quirefold.llm.voronoi_knn import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and found spans of each document; null texts have none, repeated rows are scanned one by one."""
    from quirefold.llm.secrets import listed, scan

    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; nulls, lengths, repeated ids and empty tables as in vector_graph."""
    from quirefold.llm.vector_graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


def op11_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each of the five filters at each step of all 120 orders, by source; nulls, ties and empty tables as in filter_audit."""
    from quirefold.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op12_spelling_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words with their near words, form and root; nulls, ties and empty tables as in spelling."""
    from quirefold.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the output; nulls, ties and empty tables as in chat."""
    from quirefold.llm.chat import format_chats, read_back

    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = F.transform("turns", lambda u: F.concat(u["role"], F.lit("\n"), u["text"], F.lit("\n")))
    return read_back(format_chats(talk.unionByName(own))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    "op11_filter_cube": op11_filter_cube,
    "op12_spelling_automata": op12_spelling_automata,
    "op13_chat_format": op13_chat_format,
    "op9_vector_graph": op9_vector_graph,
    "op4_secret_battery": op4_secret_battery,
    "op3_voronoi_knn": op3_voronoi_knn,
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op7_kneser_ney_langid": op7_kneser_ney_langid,
    "op10_bpe": op10_bpe,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op2_rlz_dedup": op2_rlz_dedup,
    "op5_setsketch": op5_setsketch,
    "op8_suffix_dedup": op8_suffix_dedup,
}

ORACLE: dict[str, str] = {}
ORACLE["op3_voronoi_knn"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.w, d.w) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WORD = r"[^\x20\x09-\x0D]"
ORACLE["op2_rlz_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents
), p AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, j FROM hit, unnest(range(i, i + 35)) AS t(j)
), kept AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.j) AS words, count(*) AS n
  FROM (SELECT r, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)) AS x
  LEFT JOIN gone AS g ON g.r = x.r AND g.j = x.j WHERE g.j IS NULL GROUP BY x.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLE["op8_suffix_dedup"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w,
         regexp_extract_all(coalesce(text, ''), '{_WORD}+[\x20\x09-\x0D]*') AS pieces, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead
  FROM documents
), p AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)
), hit AS (
  SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM p) WHERE n > 1
), gone AS (
  SELECT DISTINCT r, j FROM hit, unnest(range(i, i + 50)) AS t(j)
), spans AS (
  SELECT r, string_agg((a - 1) || ':' || b, ',' ORDER BY a) AS spans, CAST(sum(b - a + 1) AS BIGINT) AS n, max(b) AS last
  FROM (SELECT r, min(j) AS a, max(j) AS b FROM (SELECT r, j, j - row_number() OVER (PARTITION BY r ORDER BY j) AS run FROM gone) GROUP BY r, run) GROUP BY r
), kept AS (
  SELECT x.r, string_agg(x.piece, '' ORDER BY x.j) AS words
  FROM (SELECT r, j, pieces[j] AS piece FROM d, unnest(range(1, len(pieces) + 1)) AS t(j)) AS x
  LEFT JOIN gone AS g ON g.r = x.r AND g.j = x.j WHERE g.j IS NULL GROUP BY x.r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, coalesce(spans, '') AS spans,
       sha256(lead || coalesce(words, '') || CASE WHEN last = len(w) THEN pieces[len(w)][len(w[len(w)]) + 1:] ELSE '' END) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""

ORACLE["op5_setsketch"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS k FROM d, unnest(range(1, greatest(len(w), least(len(w), 1) + 1))) AS t(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), z AS (
  SELECT s.doc_id, k, n FROM s JOIN n USING (doc_id)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM z AS a JOIN z AS b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
"""

ORACLE["op9_vector_graph"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.w, b.w) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

ORACLE["op11_filter_cube"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)] AS fails,
    EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = w.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
  FROM w
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters AS a, letters AS b, letters AS c, letters AS d, letters AS e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS c, ord(filter_order[step]) - 64 AS own, list_transform(range(1, step), lambda k: ord(filter_order[k]) - 64) AS before
  FROM orders, unnest(range(1, 6)) AS s(step)
), r AS (
  SELECT part, filter_order, step, c, n, good, toxic, fails[own] AS fail, len(list_filter(before, lambda k: fails[k])) > 0 AS earlier,
    fails[own] AND len(list_filter(fails, lambda x: x)) = 1 AS sole
  FROM g, steps
), s AS (
  SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT fail AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT earlier), 0) AS removed,
    coalesce(sum(n) FILTER (fail AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT earlier), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, c
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM s
"""

ORACLE["op13_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)
), e AS (
  SELECT *, coalesce(lag(role) OVER w <> role, TRUE) AS first,
    length(text) + len(regexp_extract_all(text, '<\\*(/?s>|</?SYS>>)|\[\\*/?INST\]')) AS chars,
    length(role) + len(regexp_extract_all(role, '<\\*(/?s>|</?SYS>>)|\[\\*/?INST\]')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN first THEN role_chars + 6 + 7 + 4 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE["op12_spelling_automata"] = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), d AS (
  SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w
), b AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [192 + (CAST(ord(c) AS BIGINT) >> 6), 128 + (CAST(ord(c) AS BIGINT) & 63)] END)) AS bytes FROM d
), h AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, tab
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM v, unnest(range(1, length(word) + 1)) AS p(i)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts AS a JOIN cuts AS b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts AS a JOIN v AS b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts AS a JOIN v AS b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({'n': -n, 'form': other}) AS best FROM near GROUP BY word
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 5 * n THEN best.form END AS form, CASE WHEN -best.n >= 5 * n THEN -best.n END AS form_n
  FROM v LEFT JOIN best USING (word)
), way AS (
  SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT way.word, way.root FROM way JOIN f ON f.word = way.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
