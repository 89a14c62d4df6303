"""One query for each corpus operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import archives, infill, jpeg_media, langid, mixing, negatives, packing, pii, quality, rollups, simhash, suffix_dedup, topk
from larkspur.llm.common import new_path, stored, table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.media_features(jpeg_media.media_column(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listing(base), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = stored(archives.write_arcs(table(spark, sf_dir, "pages")), "arcs")
    return archives.read_warcs(stored(archives.to_warcs(arcs), "warcs"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(table(spark, sf_dir, "documents")).drop("kept")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


#: The tokenizer version to which op10 moves on, and the fewest words of a document that it does not withdraw.
NEXT_VOCABULARY, FEWEST_WORDS = "byte_bpe_multi_50k.tiktoken", 20


def op10_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under one tokenizer and then under the next; those with repeated lines are revised to
    the counts of their texts without these; those of fewer than ``FEWEST_WORDS`` words are withdrawn. Each batch
    is replayed, which changes nothing, and the batches are compacted in between."""
    text, vocabularies = F.col("text"), (rollups.VOCABULARY, NEXT_VOCABULARY)
    lines = F.split(text, "\n", -1)
    plain, repeats = F.array_join(F.array_distinct(lines), "\n"), F.size(F.array_distinct(lines)) < F.size(lines)
    docs = table(spark, sf_dir, "documents").select(
        "source", "lang", F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("words"), text, F.when(repeats, plain).alias("plain"), repeats.alias("revised")
    )
    names = {f"{which}{k}": v for k, v in enumerate(vocabularies) for which in ("old", "new")}
    told = rollups.counted(docs, {n: "text" if n.startswith("old") else "plain" for n in names}, names)
    told = stored(told, "counts")

    def under(k: int) -> DataFrame:
        return told.select("source", "lang", F.lit(vocabularies[k]).alias("tokenizer"), "words", "revised", F.col(f"old{k}").alias("old_tokens"), F.col(f"new{k}").alias("n_tokens"))

    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    for k in range(len(vocabularies)):
        rows = under(k)
        now = rows.withColumn("n_tokens", F.when(F.col("revised"), F.col("n_tokens")).otherwise(F.col("old_tokens")))
        for _ in range(2):
            rollup.commit(f"load/{k}", rollups.events("insert", rows, new="old_tokens"))
            rollup.commit(f"single lines/{k}", rollups.events("revise", rows.where("revised")))
            rollup.commit(f"withdraw/{k}", rollups.events("delete", now.where(F.col("words") < FEWEST_WORDS)))
        rollup.compact()
    return rollup.totals()


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows, k=5)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, label = table(spark, sf_dir, "embeddings"), F.col("label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(moved, F.col("vec_id") % 100 == 0)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_pii": op2_pii,
    "op3_simhash": op3_simhash,
    "op4_archives": op4_archives,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_rollups": op10_rollups,
    "op11_topk": op11_topk,
    "op12_negatives": op12_negatives,
    "op13_infill": op13_infill,
}

#: Rows of ``embeddings`` that take part, with their components as whole numbers.
_VECTORS = """
SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op11_topk": f"""
WITH e AS ({_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op12_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_VECTORS}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND place <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank FROM n)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5""",
    "op13_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS two, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT *, least(one, two) AS a, greatest(one, two) AS z, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(z - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    # base 32 of SHA-1: each five hexadecimal digits are four letters
    "op4_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d""",
    "op9_quality": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(8) o(k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines FROM d),
a AS (SELECT s.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM s LEFT JOIN r ON s.doc_id = r.doc_id),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > {quality.MOST_SYMBOLS_PERCENT} * n_words OR 100 * n_dup_lines > {quality.MOST_DUP_LINES_PERCENT} * n_lines
    OR word_chars < {quality.SHORTEST_MEAN} * n_words OR word_chars > {quality.LONGEST_MEAN} * n_words) AS kept
FROM b""",
}
