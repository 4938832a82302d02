"""Named queries of the text operators, one for each, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markerloom.llm import bpe, chat, frames, language, merkle, negatives, ordermin, packing, pii, quality, simhash, warc, wordpiece
from markerloom.sources.tables import table

#: A conversation whose texts look like another template's marks; added to the table.
PLANTED = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(list(PLANTED), "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.expand(turns.unionByName(planted)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return whole.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = ordermin.compare_edits(documents(spark, sf_dir))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        ordermin.as_text(F.col("fingerprint")).alias("fingerprint"),
        ordermin.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.BASE_KINDS), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op6_frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = frames.read_frames(frames.write_frames(documents(spark, sf_dir)))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    back = warc.read_archives(archives, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judged(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = language.prototypes(docs, ~language.held_out(F.col("doc_id")))
    found = language.predict(docs, known)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.whole_vectors(table(spark, sf_dir, "embeddings").withColumn("label", moved))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *,
    length('<|' || replace(replace(replace(role, '\\', '\\\\'), '|', '\\p'), chr(10), '\\n') || '|>' || chr(10)) AS head,
    length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM c),
s AS (SELECT *, sum(head + body + 8) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

MERKLE_SQL = """
WITH RECURSIVE l AS (
  SELECT doc_id, lang, head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail AS whole,
    head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)),
        lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM (SELECT doc_id, lang, n_chars, CAST(doc_id AS VARCHAR) AS name,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents)),
r AS (
  SELECT doc_id, lang, sha256(whole) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(other) ELSE sha256(whole) END AS start,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS m FROM l),
t AS (
  SELECT lang, 0 AS level, r AS k, m, leaf AS d FROM r UNION ALL
  SELECT lang, level + 1, k // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM t WHERE m > 1 GROUP BY lang, level, k // 2, m),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS m FROM t WHERE m = 1),
u AS (
  SELECT 0 AS level, r AS k, m, subroot AS d FROM s UNION ALL
  SELECT level + 1, k // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM u WHERE m > 1 GROUP BY level, k // 2, m),
steps AS (
  SELECT r.doc_id, own.level AS step, CASE WHEN other.d IS NULL THEN 'N' WHEN other.k < own.k THEN 'L' ELSE 'R' END AS side, coalesce(other.d, '') AS d
  FROM r JOIN t own ON own.lang IS NOT DISTINCT FROM r.lang AND own.k = r.r >> own.level AND own.m > 1
  LEFT JOIN t other ON other.lang IS NOT DISTINCT FROM own.lang AND other.level = own.level AND other.k = xor(own.k, 1)
  UNION ALL
  SELECT r.doc_id, 1000 + own.level, CASE WHEN other.d IS NULL THEN 'N' WHEN other.k < own.k THEN 'L' ELSE 'R' END, coalesce(other.d, '')
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang JOIN u own ON own.k = s.r >> own.level AND own.m > 1
  LEFT JOIN u other ON other.level = own.level AND other.k = xor(own.k, 1)),
p AS (SELECT doc_id, list(side || d ORDER BY step) AS path FROM steps GROUP BY doc_id),
f AS (
  SELECT r.doc_id, leaf, subroot, (SELECT d FROM u WHERE m = 1) AS root,
    sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(start, coalesce(path, [])),
      lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN p ON p.doc_id = r.doc_id)
SELECT *, folded_root = root AS verified FROM f
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {
    q.__name__: q
    for q in (
        op1_packing,
        op2_chat_formatting,
        op3_byte_bpe,
        op4_order_minhash,
        op5_personal_data,
        op6_frame_files,
        op7_warc,
        op8_simhash,
        op9_quality_rules,
        op10_token_counts,
        op11_language_id,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}
ORACLES = {
    "op2_chat_formatting": CHAT_SQL,
    "op7_warc": WARC_SQL,
    "op12_merkle_manifest": MERKLE_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
