"""The queries of this subpackage and the SQL that DuckDB runs beside them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spokeflow.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    fill_middle,
    html_text,
    quality,
    secret_scan,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    token_rollup,
    turn_repair,
)
from spokeflow.plans.lineage import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.proportional_shards(_table(spark, sf_dir, "documents"), shards=24)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated counts come in, exact ones revise them, copies go out, and a batch is replayed."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = written(token_rollup.token_counts(_table(spark, sf_dir, "documents"), path, "byte_bpe_50k"))
    guess = F.ceil(F.col("n_bytes") / 4).cast("long")
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit(1, token_rollup.inserts(counts.withColumn("n_tokens", guess)))
    revised = token_rollup.revisions(counts, guess, F.col("n_tokens"))
    rollup.commit(2, revised)
    first = counts.groupBy("text_md5").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = counts.join(first, "text_md5").where("doc_id > first")
    rollup.commit(3, token_rollup.deletes(copies))
    rollup.commit(2, revised)
    return rollup.totals()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), path, decode=True))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.scored(docs, model, ["doc_id", "source", "lang"], output="score")
    out = quality.judged(scored, model, F.col("source"), F.col("lang"), score=F.col("score"))
    return out.select(
        "doc_id", "source", "lang", F.col("__evidence").alias("evidence"), F.col("__host_share").alias("host_share"),
        F.col("__path_share").alias("path_share"), F.col("__posterior").alias("posterior"), F.col("__kept").alias("kept"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are written to a new folder of the shared one and read back."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    files = token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.digests(files.tokens())


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are damaged by a rule and repaired."""
    rows = turn_repair.damaged(_table(spark, sf_dir, "conversations"))
    return turn_repair.report(rows, stands=F.col("stands"))


def queries() -> dict[str, Query]:
    every = (
        op1_decontaminate, op2_substrings, op3_sharding, op4_html, op5_exact_dedup,
        op6_token_rollup, op7_bpe, op8_quality, op9_secrets, op10_simhash,
        op11_token_files, op12_fill_middle, op13_turn_repair,
    )
    return {f.__name__: f for f in every}


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

#: The CRC table comes from its rule; the text's bytes are read from its hex digits.
OP3_SQL = """
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), d AS (
  SELECT doc_id, coalesce('s' || source, '') AS stratum, source, strlen(coalesce(text, '')) + 8 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents
), c AS (
  SELECT d.* EXCLUDE (bytes), xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM d, bits
), k AS (
  SELECT *, md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size) AS h FROM c
), r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) AS r,
         count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS a
  FROM k
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, stratum, r) - 1 AS pos FROM r
), s AS (SELECT *, (pos * 24) // a AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, pos - (shard * a + 23) // 24 AS slot,
       NULL::INT AS grown_shard, source
FROM s
"""


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM d
), f AS (
  SELECT doc_id, t, n, least(r1, r2) AS a, greatest(r1, r2) AS b,
         CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM c
"""


#: One table of states over all conversations, a turn a recursion; what is repaired is carried along.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM conversations
), f AS (
  SELECT d.* EXCLUDE (bytes), xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS fault FROM d, bits
), m AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM f
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS k FROM m
), b AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unfinished, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before
  FROM n
), r AS (
  SELECT *, left(role, 1) AS ini, blank OR again AS gone, unfinished AND NOT blank AND NOT again AS cut FROM b
), c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
         count_if(cut) AS truncated, count_if(before IS NOT NULL AND left(before, 1) || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), st(s, n, name) AS (VALUES ('-', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), ins AS (
  SELECT s, s AS t, 0::BIGINT AS c, '' AS a, []::VARCHAR[] AS o FROM st UNION ALL SELECT s, n, 5, 'I', [name || ':'] FROM st
  UNION ALL SELECT x.s, y.n, 10, 'II', [x.name || ':', y.name || ':'] FROM st x JOIN st y ON y.s = x.n
), ops(op) AS (VALUES ('K'), ('R'), ('D')
), w AS (
  SELECT conv_id, 0::BIGINT AS k, '-' AS s, 0::BIGINT AS c, '' AS a, []::VARCHAR[] AS o FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k + 1, s2, min(p).c, min(p).a, arg_min(o2, p) FROM (
    SELECT w.conv_id, w.k, CASE op WHEN 'D' THEN i.t WHEN 'R' THEN st.n ELSE r.ini END AS s2,
           {'c': w.c + i.c + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN op <> 'D' AND r.cut THEN 5 ELSE 0 END, 'a': w.a || i.a || op} AS p,
           w.o || i.o || CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [st.name || ':' || r.text] ELSE [r.role || ':' || r.text] END AS o2
    FROM w JOIN ins i ON i.s = w.s JOIN st ON st.s = i.t JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k CROSS JOIN ops
    WHERE op = 'D' OR NOT r.gone AND (op = 'R' OR r.ini = st.n OR r.ini = 's' AND i.t = '-')
  ) GROUP BY conv_id, k, s2
), e AS (
  SELECT w.conv_id, {'c': w.c + i.c, 'a': w.a || i.a} AS p, w.o || i.o AS o
  FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN ins i ON i.s = w.s WHERE w.k = coalesce(c.n, 0) AND i.t IN ('-', 'a')
), z AS (SELECT conv_id, min(p) AS p, arg_min(o, p) AS o FROM e GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       z.p.c AS cost, z.p.a AS audit, sha256(array_to_string(z.o, chr(10))) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op12_fill_middle": OP12_SQL, "op13_turn_repair": OP13_SQL}
