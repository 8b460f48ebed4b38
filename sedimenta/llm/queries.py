"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import exact_dedup, html, lexical, lm, mixing, packing, pii, quality, runs, simhash, substrings, tokens, topk
from sedimenta.llm.common import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit_field(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_loops(table(spark, sf_dir, "documents"))))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_topk": op1_topk, "op2_token_counts": op2_token_counts, "op3_simhash": op3_simhash, "op5_lm_scores": op5_lm_scores, "op6_pii": op6_pii, "op7_quality": op7_quality, "op4_mixing": op4_mixing, "op8_exact_dedup": op8_exact_dedup, "op9_packing": op9_packing, "op10_html_text": op10_html_text, "op11_periodic_runs": op11_periodic_runs, "op12_substrings": op12_substrings, "op13_lexical": op13_lexical}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of a short ASCII string: eight shifts for each letter.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

ORACLE_SQL = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256({_LOWER}) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY {_LOWER})""",
    "op11_periodic_runs": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents
        ), e AS (
            SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
        ), f AS (
            SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e
        ), l AS (
            SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM f
        ), t AS (
            SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM l
        ), m AS (
            SELECT x.doc_id, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
        ), k AS (
            SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m
        ), s AS (
            SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
        ), r AS (
            SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length
        ), b AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS place FROM r
        ), u AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id
        ), c AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words
            FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY doc_id
        )
        SELECT l.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM l LEFT JOIN u ON u.doc_id = l.doc_id LEFT JOIN c ON c.doc_id = l.doc_id LEFT JOIN b ON b.doc_id = l.doc_id AND place = 1""",
    "op13_lexical": f"""
        WITH t AS (
            SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{lexical.TERM_PATTERN}')) AS term FROM documents
        ), c AS (
            SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
        ), d AS (
            SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id
        ), s AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
        ), f AS (
            SELECT term, count(*) AS df FROM c GROUP BY term
        ), i AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{lexical.TERM_PATTERN}')) AS term FROM benchmark
        ), w AS (
            SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term), s
        ), p AS (
            SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
            FROM w JOIN c USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
        ), r AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
