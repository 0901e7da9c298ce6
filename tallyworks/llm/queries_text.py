"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, ngram_join, personal_data, piece_codec, quality_vote, quotations, rule_ledger, secret_forest, toxicity, warc
from .queries import query, table

LEDGER_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
             list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS five FROM w, range(1, len(ws) - 3) r(i)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM g),
k AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d WHERE n > 1),
r AS (SELECT doc_id, sum(least(coalesce(nxt - i, 5), 5)) AS repeated FROM k GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(repeated, 0)::BIGINT AS n_repeat_words,
             length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS capitals,
             length(x) - length(regexp_replace(x, '[!?]', '', 'g')) AS marks
      FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * capitals > 50 * word_chars OR 100 * marks > 50 * n_words
            OR word_chars > 30 * n_words OR word_chars < 2 * n_words) AS kept,
       ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
        + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * capitals > 50 * word_chars)::INT
        + 32 * (100 * marks > 50 * n_words)::INT + 64 * (word_chars > 30 * n_words OR word_chars < 2 * n_words)::INT)::BIGINT AS fail_bits
FROM m
"""


@query("op4_rule_ledger", LEDGER_SQL)
def op4_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, folder, "documents"))
    base = ~rule_ledger.passes(rule_ledger.BASE)
    return rows.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & rule_ledger.passes(rule_ledger.CURRENT)).alias("kept"), "fail_bits",
    )


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join_components(table(spark, folder, "documents"), ngram_join.JoinParams(words=4, percent=85))


@query("op6_secret_forest")
def op6_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_forest.secrets(table(spark, folder, "documents"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op1_piece_codec")
def op1_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encoded(table(spark, folder, "documents"))


def fold_of(count: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % count


def classified(rows: DataFrame, held_out: Column) -> DataFrame:
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_quality_vote")
def op2_quality_vote(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(fold_of(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return classified(quality_vote.scored(docs, quality_vote.train(docs, labels)), fold_of(5) == 0)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(fold_of(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return classified(toxicity.scored(docs, toxicity.train(docs, labels)), fold_of(4) == 2)


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x, b FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last_id FROM h)
SELECT page_id, payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + (i // 8) * 10, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1), '' ORDER BY i)
                                FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM g
"""


@query("op5_warc", WARC_SQL)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), archive)
    return warc.read(spark, archive)


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = personal_data.spans(docs, personal_data.train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = lambda s: F.array_position(F.array(*map(F.lit, personal_data.KINDS)), s["kind"])
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    both = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: s.dropFields("r"))
    return found.select("doc_id", *map(count, personal_data.KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(both).alias("spans"))


@query("op10_quotations")
def op10_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.linked_conversations(table(spark, folder, "conversations"))
