"""The registered queries of the corpus operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.archives import archive_round_trip
from lacuna.llm.common import table
from lacuna.llm.decontamination import contamination
from lacuna.llm.fingerprints import fingerprint_documents
from lacuna.llm.jaccard_join import near_duplicates
from lacuna.llm.packing import conversation_examples, pack_documents, pack_examples
from lacuna.llm.personal_data import find_personal_data, sanitise
from lacuna.llm.prefix_trie import prefix_trie
from lacuna.llm.quality import score_quality
from lacuna.llm.quality import train as train_quality
from lacuna.llm.runs import periodic_runs, run_report, with_planted_runs
from lacuna.llm.secrets import scan_secrets, train_field
from lacuna.llm.substring_dedup import without_repeats
from lacuna.llm.token_counts import count_tokens
from lacuna.llm.toxicity import score_documents, train


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), 4096)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1024)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), 400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, train_field(docs))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), 1000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 80)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("p", "q")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), 12))


def personal_data_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with values named by kind and disclosing terms generalised or removed."""
    return sanitise(table(spark, sf_dir, "documents"))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations in sequences of at most 4096 tokens, 16 conversations and 3072 tokens that bear loss; too long ones have no sequence."""
    examples = conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_file("byte_bpe_50k.json"))
    return pack_examples(examples, 4096, 16, 3072).withColumnRenamed("id", "conv_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_decontamination, op3_token_counts, op4_packing, op5_suffix_dedup, op6_personal_data, op7_secrets, op8_toxicity, op9_archives, op10_jaccard_join,
        op11_prefix_trie, op12_quality, op13_periodic_runs, packing_conversations, personal_data_sanitised,
    )
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_fingerprints": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS following
  FROM documents),
t AS (
  SELECT doc_id, length(text) AS n_chars, text, following,
         left(text, (length(text) - length(text) // 3)::INT) || left(following, (length(text) // 3)::INT) AS edited
  FROM d),
v AS (
  SELECT doc_id, 'own' AS k, text AS x FROM t UNION ALL SELECT doc_id, 'edited', edited FROM t UNION ALL SELECT doc_id, 'next', following FROM t),
w AS (
  SELECT doc_id, k, list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda q: q <> '') AS w FROM v),
h AS (
  SELECT doc_id, k, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: left(md5(array_to_string(w[i:i + 4], ' ')), 16)))) END AS h FROM w),
s AS (
  SELECT doc_id, k, h, list_filter(h, lambda q: q < '2') AS below FROM h),
b AS (
  SELECT doc_id, k, len(h) AS n, CASE WHEN len(below) < 32 THEN h[1:32] ELSE below END AS hashes, len(below) AS n_below FROM s),
f AS (
  SELECT doc_id, k, hashes, CASE WHEN len(hashes) = n THEN 'g' WHEN n_below < 32 THEN hashes[-1] ELSE '2' END AS bound FROM b),
o AS (
  SELECT a.doc_id, a.hashes AS h0, a.bound AS b0, e.hashes AS h1, e.bound AS b1, x.hashes AS h2, x.bound AS b2
  FROM f a JOIN f e ON a.doc_id = e.doc_id JOIN f x ON a.doc_id = x.doc_id WHERE a.k = 'own' AND e.k = 'edited' AND x.k = 'next'),
c AS (
  SELECT doc_id, h0, b0, h1, b1,
    list_filter(h0, lambda q: q <= least(b0, b1)) AS p1, list_filter(h1, lambda q: q <= least(b0, b1)) AS q1,
    list_filter(h0, lambda q: q <= least(b0, b2)) AS p2, list_filter(h2, lambda q: q <= least(b0, b2)) AS q2 FROM o),
n AS (
  SELECT *, len(list_intersect(p1, q1)) AS i1, len(list_intersect(p2, q2)) AS i2 FROM c)
SELECT t.doc_id, t.n_chars::BIGINT AS n_chars, sha256(t.edited) AS edited_sha256,
  b0 || ':' || array_to_string(h0, ',') AS fingerprint, b1 || ':' || array_to_string(h1, ',') AS edited_fingerprint,
  CASE WHEN len(p1) + len(q1) = 0 THEN 1.0 ELSE i1::DOUBLE / (len(p1) + len(q1) - i1) END AS near_edited,
  CASE WHEN len(p2) + len(q2) = 0 THEN 1.0 ELSE i2::DOUBLE / (len(p2) + len(q2) - i2) END AS near_next,
  CASE WHEN len(p1) = 0 THEN 0.0 ELSE i1::DOUBLE / len(p1) END AS contained_in_edited,
  CASE WHEN len(p2) = 0 THEN 0.0 ELSE i2::DOUBLE / len(p2) END AS contained_in_next
FROM t JOIN n USING (doc_id)""",
    "op2_decontamination": rf"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda q: q <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS x, least(len(w), 10) AS size
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda q: q <> '') AS w FROM documents),
places AS (
  SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM win))),
hits AS (SELECT DISTINCT doc_id, p, places.size, item FROM places JOIN win ON places.x = win.x AND places.size = win.size),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, octet_length(encode(payload)) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM q""",
    "op11_prefix_trie": """
WITH t AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id AS c, list(struct_pack(g := g, chars := chars) ORDER BY turn NULLS FIRST, g) AS turns,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT o.c, list_concat(CASE WHEN p.c IS NULL OR o.h = 0 THEN [] ELSE p.turns[1:o.h] END, o.turns[o.h + 1:]) AS turns FROM o LEFT JOIN o p ON p.c = o.c - o.c % 100),
m AS (
  SELECT c, d, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.g), '') AS k, array_to_string(list_transform(turns[1:d - 1], lambda x: x.g), '') AS above,
    CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
v AS (
  SELECT d, k, any_value(above) AS above, any_value(chars) AS chars, min(c) AS c, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256
  FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, above AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY ALL),
leaf AS (SELECT v.* FROM v LEFT JOIN kids USING (d, k) WHERE kids.k IS NULL),
leaves AS (SELECT m.d, m.k, count(*) AS n_leaves FROM leaf JOIN m ON m.c = leaf.c AND m.d <= leaf.d GROUP BY ALL),
saved AS (SELECT m.d, m.k, sum((v.n_convs - 1) * v.chars) AS saved_tokens FROM v JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY ALL)
SELECT v.c AS conv_id, v.d::BIGINT AS depth, up.c AS parent_conv_id, v.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v LEFT JOIN v up ON up.d = v.d - 1 AND up.k = v.above AND v.d > 0 LEFT JOIN kids ON kids.d = v.d AND kids.k = v.k
  JOIN leaves ON leaves.d = v.d AND leaves.k = v.k JOIN saved ON saved.d = v.d AND saved.k = v.k""",
}
