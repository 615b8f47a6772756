"""The registered queries of the operators, and their expected results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import (
    bpe, chat, exact, licenses, lines, mixing, packing, phrases, search, secrets, simhash, toxicity,
    vectors)
from tallyloom.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, tagger).select(
        "doc_id", F.coalesce(toxicity.is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(tricky)))


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_links(_table(spark, sf_dir, "embeddings"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("rid")


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_collocations(_table(spark, sf_dir, "documents"))


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan,
    "op2_toxicity": toxic_documents,
    "op3_source_mix": source_mix,
    "op4_license_scan": license_scan,
    "op5_simhash": simhash_groups,
    "op6_chat_format": chat_format,
    "op7_embedding_dedup": embedding_links,
    "op8_exact_dedup": exact_dedup,
    "op9_line_dedup": line_dedup,
    "op10_packing": packed_pieces,
    "op11_collocations": collocations,
    "op12_ranked_search": ranked_documents,
    "op13_bpe": bpe_round_trip,
}

ORACLES = {
    "op3_source_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
            FROM documents
        ), per_source AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
            FROM sized GROUP BY source
        ), levels AS (
            SELECT *, 3 * source_size AS cap,
                   ((SELECT CAST(sum(size) AS BIGINT) FROM sized) - coalesce(CAST(sum(3 * source_size) OVER (
                        ORDER BY (3 * source_size) / weight, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
                   / CAST(sum(weight) OVER (ORDER BY (3 * source_size) / weight, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
            FROM per_source
        ), goals AS (
            SELECT source, source_size,
                   least(CAST(cap AS DOUBLE), weight * (SELECT max(level) FROM levels)) AS target
            FROM levels
        ), placed AS (
            SELECT s.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
                   CAST(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reach
            FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0
                    ELSE (budget // source_size) * size
                         + greatest(0, least(size, budget % source_size - (reach - size))) END AS taken
        FROM placed""",
    "op7_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        ), linked AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
        ), least_reached AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT v.vec_id, (SELECT count(*) FROM linked WHERE a = v.vec_id) AS n_links, component_id,
               v.vec_id = component_id AS kept
        FROM v JOIN least_reached ON a = v.vec_id""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11)
                       || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
                  FROM documents)
        ), repeated AS (
            SELECT key, min(doc_id) AS first FROM split WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) > 1
        ), judged AS (
            SELECT s.*, r.key IS NOT NULL AND s.doc_id <> r.first AS dropped
            FROM split s LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op11_collocations": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), pieces AS (
            SELECT d, lang, unnest(cut) AS piece, generate_subscripts(cut, 1) AS p
            FROM (SELECT d, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS cut FROM docs)
        ), words AS (
            SELECT d, lang, p, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
            FROM (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)
        ), runs AS (
            SELECT lang, word AS w1, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3
            FROM words WINDOW w AS (PARTITION BY d, p ORDER BY pos)
        ), n AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
        ), f AS MATERIALIZED (
            SELECT lang, w1 AS phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10
            UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
            UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
        ), candidates AS (
            SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE contains(phrase, ' ')
        ), cuts AS (
            SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
                   CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(l.a AS HUGEINT) * r.a) AS score
            FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM candidates) c
            JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ')
            JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, phrase, max(a) AS most FROM (
                SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
                FROM candidates WHERE len(ws) = 3) GROUP BY ALL
        )
        SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank,
               s.phrase, s.a, s.l, s.r, n.n, CAST(score AS BIGINT) AS score
        FROM scored s JOIN n USING (lang) LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
        WHERE most IS NULL OR 100 * most < 50 * a
        QUALIFY rank <= 2000""",
    "op12_ranked_search": r"""
        WITH terms AS (
            SELECT d, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
        ), held AS (SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
        ), sizes AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY d
        ), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM held, total GROUP BY term, docs
        ), asked AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
        ), scored AS (
            SELECT item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf)
                       // (1000 * tf + 12 * (75 + ((25 * n * docs) // words))))) AS BIGINT) AS score
            FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (d), total
            GROUP BY ALL
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
               doc_id, score
        FROM scored WHERE score > 0 QUALIFY rank <= 20""",
}
