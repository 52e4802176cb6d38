"""The corpus queries over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import bbpe, dialogue, exact, hardneg, html_main, langid, media, minhash, packing, piecebpe, quality, sepscan, tokens_orc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sepscan.document_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_orc.token_binary_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damaged(turns), turns)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_html_text": op2_html_text,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_minhash": op5_minhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_media_columns": op7_media_columns,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_token_orc": op10_token_orc,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_hard_negatives": op13_hard_negatives,
}


def _repair_sql() -> str:
    """Cost, audit and repaired rows of each grammar state (0 nothing yet, 1 after s, 2 after u, 3 after a), from the last row to the first."""
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    goal = [2, 2, 3, 2]
    word = ["user", "user", "assistant", "user"]
    options, relaxed, taken = [], [], []
    for q in range(4):
        keep = " ".join(f"WHEN ok AND i = '{r}' THEN 5 * truncated + c{to}" for r, to in after[q].items())
        options += [f"2 + c{q} AS d{q}", f"CASE {keep} END AS k{q}", f"CASE WHEN ok THEN 1 + 5 * truncated + c{goal[q]} END AS r{q}"]
        kept = " ".join(f"WHEN '{r}' THEN {to}" for r, to in after[q].items())
        taken.append(f"CASE i {kept} END AS t{q}")
        relaxed.append(f"least(d{q}, k{q}, r{q}) AS b{q}")
    once = [f"least(b{q}, 5 + b{goal[q]}, 10 + b{goal[goal[q]]}) AS n{q}" for q in range(4)]
    pick = [f"CASE WHEN n{q} = d{q} THEN 'D' WHEN n{q} = 5 + n{goal[q]} THEN 'I' WHEN n{q} = k{q} THEN 'K' ELSE 'R' END AS l{q}" for q in range(4)]
    # what a state does with the row once nothing is inserted before it
    one = lambda q, a: f"CASE l{q} WHEN 'D' THEN {'{'}a: 'D' || {a}{q}.a, x: {a}{q}.x{'}'} WHEN 'K' THEN {'{'}a: 'K' || list_extract([{a}1, {a}2, {a}3], t{q}).a, x: list_prepend(role || ':' || text, list_extract([{a}1, {a}2, {a}3], t{q}).x){'}'} WHEN 'R' THEN {'{'}a: 'R' || {a}{goal[q]}.a, x: list_prepend('{word[q]}:' || text, {a}{goal[q]}.x){'}'} END"
    own = [f"{one(q, 's')} AS o{q}" for q in range(4)]
    more = lambda q, s: f"{'{'}a: 'I' || {s}.a, x: list_prepend('{word[q]}:', {s}.x){'}'}"
    full = []
    for q in range(4):
        g, h = goal[q], goal[goal[q]]
        full.append(f"CASE WHEN l{q} <> 'I' THEN o{q} WHEN l{g} <> 'I' THEN {more(q, f'o{g}')} ELSE {more(q, f'({more(g, f"o{h}")})')} END AS s{q}")
    cols = ", ".join([f"n{q} AS c{q}" for q in range(4)] + full)
    return f"""
        WITH RECURSIVE crc_table AS (
            SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS _(i)
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
        ), coded AS (
            SELECT * EXCLUDE (key), xor(4294967295::BIGINT, list_reduce(list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS d FROM keyed, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS n
            FROM coded WHERE d <> 0
        ), faults AS (
            SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) > 1 AS again,
                   row_number() OVER w AS pos, lag(role) OVER w AS role_before, substr(role, 1, 1) AS i, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), n)
        ), rows AS (
            SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS truncated,
                   bare <> '' AND NOT again AS ok, count(*) OVER (PARTITION BY conv) AS size FROM faults
        ), walk AS (
            SELECT conv, max(pos) + 1 AS pos, 0::BIGINT AS c0, 10::BIGINT AS c1, 5::BIGINT AS c2, 0::BIGINT AS c3, {'{'}a: '', x: []::VARCHAR[]{'}'} AS s0, {'{'}a: 'II', x: ['user:', 'assistant:']{'}'} AS s1, {'{'}a: 'I', x: ['assistant:']{'}'} AS s2, {'{'}a: '', x: []::VARCHAR[]{'}'} AS s3 FROM rows GROUP BY conv
            UNION ALL
            SELECT conv, pos, {cols}
            FROM (SELECT *, {', '.join(own)} FROM (SELECT *, {', '.join(pick)} FROM (SELECT *, {', '.join(once)} FROM (SELECT *, {', '.join(relaxed)} FROM (
                SELECT r.conv, r.pos, role, text, {', '.join(taken)}, s0, s1, s2, s3, {', '.join(options)}
                FROM walk JOIN rows r ON r.conv = walk.conv AND r.pos = walk.pos - 1)))))
        ), report AS (
            SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated,
                   count_if(role_before IS NOT NULL AND substr(role_before, 1, 1) || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM rows GROUP BY conv
        ), done AS (
            SELECT report.*, c0 AS cost, s0.a AS audit, sha256(array_to_string(s0.x, chr(10))) AS repaired_sha256 FROM report JOIN walk ON report.conv = walk.conv AND walk.pos = 1
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done ON o.conv_id IS NOT DISTINCT FROM done.conv_id
    """


ORACLE_SQL = {
    "op11_conversation_repair": _repair_sql(),
    "op3_exact_dedup": """
        WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM norm
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10
    """,
}
