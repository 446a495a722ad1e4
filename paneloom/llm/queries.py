"""Named queries over the text tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.catalog.fixtures import Query, table
from paneloom.llm import (
    bpe,
    conversations,
    decontamination,
    jaccard,
    licenses,
    line_dedup,
    merkle,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)
from paneloom.llm.common import lower_ascii

SHARDS = 8
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


SHARD_SQL = r"""
WITH RECURSIVE steps(k, c, j) AS (
  SELECT k, CAST(k AS BIGINT), 0 FROM range(256) t(k)
  UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, j + 1
  FROM steps WHERE j < 8
), crc_table AS (
  SELECT list(c ORDER BY k) AS entries FROM steps WHERE j = 8
), docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h,
    octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(
      list_transform(range(0, n), lambda i:
        CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, list_extract(entries, CAST(xor(c & 255, b) + 1 AS BIGINT))),
      CAST(4294967295 AS BIGINT))) AS crc
  FROM docs, crc_table
), placed AS (
  SELECT doc_id, size, crc, CAST(sum(size) OVER () AS BIGINT) AS total,
    CAST(sum(size) OVER (ORDER BY doc_id, size, crc ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done
  FROM sized
), sharded AS (
  SELECT doc_id, size, crc, CAST((2 * done - size) * 8 // (2 * total) AS INTEGER) AS shard
  FROM placed
)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, crc) - 1 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM sharded
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "row.doc_id", "score", "predicted"
    ).withColumn("held_out", held_out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.drop_shared_lines(docs, min_docs=10)
    return cut.select(
        "row.doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


LINE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts
  FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs
), keyed AS (
  SELECT rid, doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
  CAST(count(*) FILTER (s.key IS NOT NULL) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL), ''))
    AS kept_sha256
FROM keyed k LEFT JOIN shared s ON k.key = s.key GROUP BY rid
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


PASSAGE_SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size,
    array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i)
  WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT rid, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)
), hits AS (
  SELECT d.rid, d.i, d.size, m.item
  FROM doc_windows d JOIN item_windows m ON d.win = m.win AND d.size = m.size
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS t(p) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items,
    string_agg(DISTINCT item, ',' ORDER BY item) AS list
  FROM hits GROUP BY rid
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules, carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), "class_id", "copy_of", "n_copies", "n_links"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, VOCABULARY, carry=["doc_id"]).select(
        "row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return cut.select(
        "row.doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


REPEAT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h,
    octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), windows AS (
  SELECT rid, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m
  FROM docs, unnest(range(0, n - 199)) AS t(i)
), twice AS (
  SELECT m FROM windows GROUP BY m HAVING count(*) > 1
), starts AS (
  SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END
    AS fresh
  FROM windows JOIN twice USING (m)
), numbered AS (
  SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS span FROM starts
), spans AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY rid, span
), pieces AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS done FROM spans
), cut AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, CAST(2 * done + 1 AS BIGINT), CAST(2 * (a - done) AS BIGINT)), ''
      ORDER BY a) AS head
  FROM pieces JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT))))
    AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return derived.select(
        F.col("page").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date",
        "payload_digest", "block_digest",
        F.octet_length("block").cast("long").alias("n_bytes"),
        F.sha2(F.col("headers").cast("binary"), 256).alias("headers_sha256"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])

    def labels(detections):
        own = F.array_distinct(F.transform(detections, lambda d: d["label"]))
        return F.array_join(F.array_sort(own), ",")

    return found.select(
        "row.doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(
            F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)
        ).alias("score"),
    )


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.row_digest(
        [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in LEAF]
    )
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(
        docs.withColumn("tampered", F.when(chosen, tampered)), LEAF, carry=["doc_id", "tampered"]
    )
    shown = F.coalesce("row.tampered", "leaf")
    return merkle.prove(made).select(
        "row.doc_id", "leaf", "subroot", "root",
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        merkle.folded(shown, F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


MERKLE_SQL = r"""
WITH RECURSIVE cells AS (
  SELECT doc_id, source, row_number() OVER () AS rid,
    concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
      coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM documents
), steps(k, c, j) AS (
  SELECT k, CAST(k AS BIGINT), 0 FROM range(256) t(k)
  UNION ALL
  SELECT k, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, j + 1
  FROM steps WHERE j < 8
), crc_table AS (
  SELECT list(c ORDER BY k) AS entries FROM steps WHERE j = 8
), leaves AS (
  SELECT doc_id, source, sha256(head || tail) AS leaf, sha256(head || lowered) AS tampered,
    xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, list_extract(entries, CAST(xor(c & 255, b) + 1 AS BIGINT))))) % 5 = 0
      AS chosen,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || tail)) - 1
      AS place,
    count(*) OVER (PARTITION BY source) AS n
  FROM cells, crc_table
), nodes(level, tree, idx, digest, n) AS (
  SELECT 0, tree, place, leaf, n FROM leaves
  UNION ALL
  SELECT level + 1, tree, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)),
    CAST(ceil(any_value(n) / 16.0) AS BIGINT)
  FROM nodes WHERE n > 1 GROUP BY level, tree, idx // 16
), subroots AS (
  SELECT tree, level AS depth, digest AS subroot, count(*) OVER () AS trees FROM nodes WHERE n = 1
), top(level, idx, digest, n) AS (
  SELECT 0, tree, subroot, trees FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)),
    CAST(ceil(any_value(n) / 16.0) AS BIGINT)
  FROM top WHERE n > 1 GROUP BY level, idx // 16
), every AS (
  SELECT tree, level, idx, digest FROM nodes WHERE n > 1
  UNION ALL
  SELECT -1, level, idx, digest FROM top WHERE n > 1
), beside AS (
  SELECT tree, level, idx,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 16 ORDER BY idx
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every
), root AS (
  SELECT digest AS root FROM top WHERE n = 1
), walk(of_tree, of_place, tree, level, idx, h, proof) AS (
  SELECT tree, place, tree, 0, place, CASE WHEN chosen THEN tampered ELSE leaf END, ''
  FROM leaves
  UNION ALL
  SELECT w.of_tree, w.of_place, CASE WHEN up.tree IS NULL THEN -1 ELSE w.tree END,
    CASE WHEN up.tree IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN up.tree IS NULL THEN w.tree ELSE w.idx // 16 END,
    CASE WHEN up.tree IS NULL THEN w.h ELSE sha256(up.l || w.h || up.r) END,
    CASE WHEN up.tree IS NULL THEN w.proof ELSE w.proof || up.l || up.r END
  FROM walk w LEFT JOIN beside up ON w.tree = up.tree AND w.level = up.level AND w.idx = up.idx
  WHERE up.tree IS NOT NULL OR w.tree >= 0
), ended AS (
  SELECT of_tree, of_place, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof
  FROM walk WHERE tree < 0 GROUP BY of_tree, of_place
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM leaves JOIN ended ON tree = of_tree AND place = of_place JOIN subroots USING (tree), root
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_classes(docs, carry=["doc_id"]).select(
        "row.doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    every = rows.select("conv_id").distinct()
    return conversations.repair(conversations.damaged(rows), every=every).withColumnRenamed(
        "conv", "conv_id"
    )


QUERIES = {
    "op1_sharding": Query(op1_sharding, SHARD_SQL),
    "op2_toxicity": Query(op2_toxicity),
    "op3_line_dedup": Query(op3_line_dedup, LINE_SQL),
    "op4_decontamination": Query(op4_decontamination, PASSAGE_SQL),
    "op5_quality": Query(op5_quality),
    "op6_jaccard": Query(op6_jaccard),
    "op7_bpe": Query(op7_bpe),
    "op8_suffix_dedup": Query(op8_suffix_dedup, REPEAT_SQL),
    "op9_warc": Query(op9_warc),
    "op10_licenses": Query(op10_licenses),
    "op11_merkle": Query(op11_merkle, MERKLE_SQL),
    "op12_simhash": Query(op12_simhash),
    "op13_conversations": Query(op13_conversations),
}
