"""The registered queries of these operators; tables are read whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, html, language, mixing, packing, pii, quality, repair, repeats, resample, simhash, toxicity, warc
from .common import table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs), with_text=False)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An index of its own for each run: the query is about all documents, and a
    # session without a metastore does not know what folders an earlier one left.
    index = exact.DigestIndex(spark, f"llm_digest_index_{uuid.uuid4().hex}")
    found = exact.deduplicate(table(spark, sf_dir, "documents"), index, batches=3)
    # What is left to compute reads written tables and not the index.
    index.clear()
    return found.drop("id_key", "text_key")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.assessed(conversations, repair.damaged(conversations))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op4_repeats": op4_repeats,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_warc": op12_warc,
    "op13_resampling": op13_resampling,
}

#: crc32 of texts: the table of the bytes, then `crc(value)` for the texts in the table `texts(value)`.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), hexes AS (
  SELECT value, hex(encode(value)) AS h FROM texts
), crcs AS (
  SELECT value, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k:
           (instr('0123456789ABCDEF', h[2 * k + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * k + 2]) - 1)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc
  FROM hexes, crc_table
)
"""

SQL = {
    "op4_repeats": r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), t AS (
  SELECT k, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), p AS (
  SELECT k, words, unnest(range(1, len(words) - 33)) AS pos FROM w WHERE len(words) >= 35
), r AS (
  SELECT k, pos FROM (
    SELECT k, pos, count(*) OVER (PARTITION BY array_to_string(words[pos:pos + 34], ' ')) AS n FROM p
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT k, unnest(range(pos, pos + 35)) AS i FROM r
), kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM t ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (k)
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (
           PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
""",
    "op11_repair": rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS value
  FROM conversations
), texts AS (
  SELECT DISTINCT value FROM o
), {CRC_SQL}, d AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM o JOIN crcs USING (value)
), n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, lag(role[1]) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), f AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
         body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         body = '' OR again AS dead, CASE WHEN body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS x
  FROM n
), ends AS (
  SELECT conv_id, max(i) + 1 AS i FROM f GROUP BY conv_id
), best AS (
  -- Least cost and audit from row i on, by the state before it.
  SELECT conv_id, i, {{'c': 0, 'a': ''}} AS b0, {{'c': 6, 'a': 'II'}} AS b1, {{'c': 3, 'a': 'I'}} AS b2, {{'c': 0, 'a': ''}} AS b3
  FROM ends
  UNION ALL
  SELECT conv_id, i,
         list_min([e0, {{'c': e2.c + 3, 'a': 'I' || e2.a}}, {{'c': e3.c + 6, 'a': 'II' || e3.a}}]),
         list_min([e1, {{'c': e2.c + 3, 'a': 'I' || e2.a}}, {{'c': e3.c + 6, 'a': 'II' || e3.a}}]),
         list_min([e2, {{'c': e3.c + 3, 'a': 'I' || e3.a}}]),
         list_min([e3, {{'c': e2.c + 3, 'a': 'I' || e2.a}}])
  FROM (
    SELECT f.conv_id, f.i,
           list_min([{{'c': b0.c + 4, 'a': 'D' || b0.a}},
             {{'c': CASE WHEN role[1] = 's' AND NOT dead THEN b1.c + x ELSE 1000000000 END, 'a': 'K' || b1.a}},
             {{'c': CASE WHEN role[1] = 'u' AND NOT dead THEN b2.c + x ELSE 1000000000 END, 'a': 'K' || b2.a}},
             {{'c': CASE WHEN dead THEN 1000000000 ELSE b2.c + 3 + x END, 'a': 'R' || b2.a}}]) AS e0,
           list_min([{{'c': b1.c + 4, 'a': 'D' || b1.a}},
             {{'c': CASE WHEN role[1] = 'u' AND NOT dead THEN b2.c + x ELSE 1000000000 END, 'a': 'K' || b2.a}},
             {{'c': CASE WHEN dead THEN 1000000000 ELSE b2.c + 3 + x END, 'a': 'R' || b2.a}}]) AS e1,
           list_min([{{'c': b2.c + 4, 'a': 'D' || b2.a}},
             {{'c': CASE WHEN role[1] = 'a' AND NOT dead THEN b3.c + x ELSE 1000000000 END, 'a': 'K' || b3.a}},
             {{'c': CASE WHEN dead THEN 1000000000 ELSE b3.c + 3 + x END, 'a': 'R' || b3.a}}]) AS e2,
           list_min([{{'c': b3.c + 4, 'a': 'D' || b3.a}},
             {{'c': CASE WHEN role[1] = 'u' AND NOT dead THEN b2.c + x ELSE 1000000000 END, 'a': 'K' || b2.a}},
             {{'c': CASE WHEN dead THEN 1000000000 ELSE b2.c + 3 + x END, 'a': 'R' || b2.a}}]) AS e3
    FROM best JOIN f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.i = best.i - 1)
), v AS (
  SELECT conv_id, CAST(b0.c AS BIGINT) AS cost, b0.a AS audit FROM best WHERE i = 1
), e AS (
  SELECT conv_id, audit, j, audit[j] AS op, length(replace(audit, 'D', '')) AS m,
         j - length(replace(audit[:j], 'I', '')) AS ins,
         length(replace(audit[:j], 'I', '')) AS i, length(replace(audit[:j], 'D', '')) - 1 AS place
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM v)
), t AS (
  SELECT e.conv_id, sha256(string_agg(
           CASE WHEN op = 'K' THEN role WHEN (place - m % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS repaired_sha256
  FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = greatest(e.i, 1)
  WHERE op <> 'D' GROUP BY e.conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k
LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
""",
    "op12_warc": r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op13_resampling": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents)
), dw AS (
  SELECT k, unnest(words) AS value FROM d
), bw AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS value
  FROM benchmark
), texts AS (
  SELECT value FROM dw UNION SELECT value FROM bw
), {CRC_SQL}, s AS (
  SELECT crc % 10000 AS bucket, count(*) AS n FROM dw JOIN crcs USING (value) GROUP BY 1
), t AS (
  SELECT crc % 10000 AS bucket, count(*) AS n FROM bw JOIN crcs USING (value) GROUP BY 1
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(
           CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE)
           / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE))
         )) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)
), w AS (
  SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN crcs USING (value) JOIN g ON bucket = crc % 10000 GROUP BY k
), r AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score,
         len(words) >= 20 AS enough
  FROM d LEFT JOIN w USING (k)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place,
         count(*) OVER (PARTITION BY enough) AS n
  FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 10 * n // 100 THEN place END AS rank FROM p
""",
}
