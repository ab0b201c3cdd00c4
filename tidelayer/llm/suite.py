"""The registered queries of the operators, with production parameters, and their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelayer.llm import licences, mixing, quality
from tidelayer.llm.conversations import audits, conversation_digests, plan_repair, repaired_turns
from tidelayer.llm.decontamination import contamination, n_hit
from tidelayer.llm.exact_dedup import exact_duplicates
from tidelayer.llm.jaccard import linked_components
from tidelayer.llm.packing import pack
from tidelayer.llm.passages import repeated_passages
from tidelayer.llm.spelling import spelling_groups, word_counts
from tidelayer.llm.texts import documents
from tidelayer.llm.tokens import count_tokens
from tidelayer.llm.topk import top_k
from tidelayer.llm.warc import page_captures, read_archives, write_archives
from tidelayer.session import run_dir


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"), path)
    return page_captures(read_archives(spark, path, blocks=False))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), max_repetition=MAX_REPETITION)
    return mixed.selectExpr("doc_id", "source", "__epoch AS epoch", "__tokens AS tokens", "__weight AS weight", "__order AS order_key")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways: each document that shares a passage has a row of its own as `doc_id`. Links of any length lead within a `class_id`."""
    found = repeated_passages(documents(spark, sf_dir))
    mine, other = ["doc_id", "first_word", "n_words"], ["of_doc_id", "of_first_word", "of_n_words"]
    rest = ["similarity", "class_id"]
    names = [*mine, *other, *rest]
    ways = [F.struct(*(F.col(c).alias(n) for c, n in zip(way, names, strict=True))) for way in ([*mine, *other, *rest], [*other, *mine, *rest])]
    return found.select(F.inline(F.array(*ways)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels, may_learn=~quality.is_held_out()))
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, left open, repeated or given another role, by a hash of conversation and turn."""
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))) % 20
    text = F.coalesce("text", space)
    rows = conversations.where(h != 0).select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    repair = plan_repair(damaged(conversations))
    ids = conversations.select("conv_id").distinct()
    found, digests = audits(repair).withColumnRenamed("conv_id", "id"), conversation_digests(repaired_turns(repair)).withColumnRenamed("conv_id", "same")
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("same")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))

    def damage(run: Column) -> Column:
        """One code point less where 97 divides the hash; a row without an id keeps its words."""
        at = (h % F.length(run)).cast("int")
        return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return spelling_groups(word_counts(documents(spark, sf_dir), damage=damage))


MAX_REPETITION = 1.25

OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS first_id FROM p GROUP BY html),
d AS (
  SELECT page_id, html, first_id, sha1(html) AS h FROM p JOIN g USING (html)),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS twenties FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(twenties, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM v
"""

OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""

OP11_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS width, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)),
places AS (
  SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - width + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT width FROM items))),
hits AS (SELECT p.doc_id, p.i, p.width, m.item_id FROM places p JOIN items m USING (width, win)),
words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS w FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""

OP12_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT)) AS b
  FROM conversations, crc),
hashed AS (
  SELECT * EXCLUDE (t, b), xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS h
  FROM coded),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS solid
  FROM damaged),
r AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS i0,
         CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM placed),
ins(a, b, cost, letters, added) AS (VALUES
  (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
  (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
act(a, b, letter, i) AS (VALUES
  (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'),
  (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL)),
way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT w.conv_id, w.k + 1, act.b, w.cost + ins.cost + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END,
         w.audit || ins.letters || letter,
         list_concat(w.lines, ins.added, CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE act.b WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END)
  FROM way w JOIN ins ON ins.a = w.state JOIN act ON act.a = ins.b JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1
  WHERE (letter = 'D' OR fault NOT IN ('b', 'd')) AND (letter <> 'K' OR act.i = r.i)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, act.b ORDER BY w.cost + ins.cost + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 't' THEN 5 ELSE 0 END, w.audit || ins.letters || letter) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i0 || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM r GROUP BY conv_id),
best AS (
  SELECT c.*, w.cost + ins.cost AS cost, w.audit || ins.letters AS audit, array_to_string(list_concat(w.lines, ins.added), chr(10)) AS left_over
  FROM counts c JOIN way w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.k = c.n JOIN ins ON ins.a = w.state AND ins.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY w.cost + ins.cost, w.audit || ins.letters) = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left_over, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents) GROUP BY 1, 2),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM bytes, crc),
changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
rest AS (
  SELECT word, n, i, length(word) AS size, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM rest a JOIN rest b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION SELECT r.word, s.word, s.n FROM rest r JOIN w s ON s.word = r.rest
  UNION SELECT s.word, r.word, r.n FROM rest r JOIN w s ON s.word = r.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
path AS (SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form, CAST(f.form_n AS BIGINT) AS form_n, p.at AS root
FROM forms f JOIN (SELECT p.word, p.at FROM path p JOIN forms e ON e.word = p.at WHERE e.form IS NULL) p ON p.word = f.word
"""

QUERIES = {
    "op1_pack": op1_pack,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard": op3_jaccard,
    "op4_top_k": op4_top_k,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_quality": op9_quality,
    "op10_licences": op10_licences,
    "op11_decontamination": op11_decontamination,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

OP7_SQL = mixing.sql(MAX_REPETITION, "greatest(1, ceil(log(greatest(1, count(*)) / 4096.0) / log(16)))")

ORACLE = {
    "op3_jaccard": OP3_SQL,
    "op4_top_k": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op10_licences": licences.sql(),
    "op11_decontamination": OP11_SQL,
    "op12_conversations": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
