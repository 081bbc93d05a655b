"""The operators bound to the test tables: one query for each, with production parameters, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, decontaminate, filter_audit, fingerprints, importance, lang_id, permutation_index, pii, quality, repeats, simhash, token_file, url_rules
from rankloom.llm.common import held_out, place, read

Query = Callable[[SparkSession, str], DataFrame]


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, folder, "pages"), rules)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = lang_id.fit(docs)
    found = lang_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    network = quality.fit(docs, read(spark, folder, "labels"))
    return quality.score(docs, network).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark, "ids")
    token_file.write(read(spark, folder, "documents"), path)
    return token_file.read(spark, path).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.drop_repeats(read(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeat"),
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    return decontaminate.matches(docs, benchmark)


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = byte_bpe.round_trip(read(spark, folder, "documents"))
    return done.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return permutation_index.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found, spans = pii.find(read(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter(spans, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col(spans)).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )


def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.next_edits(read(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.draw(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def queries() -> dict[str, Query]:
    return {name: query for name, query in globals().items() if name.startswith("op")}


_FITS = " ".join(
    f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN {{}}"
    for host, path, _ in sorted(URL_RULES, key=lambda rule: -len(rule[0] + rule[1]))
)
_RULES = sorted(URL_RULES, key=lambda rule: -len(rule[0] + rule[1]))

_WORDS = rf"""regexp_extract_all(translate(coalesce(text, ''), '{importance.UPPER}', '{importance.LOWER}'), '{importance.WORD}')"""

SQL: dict[str, str] = {
    "op1_url_rules": rf"""
        WITH parts AS (
            SELECT page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS raw,
                coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), lowered AS (SELECT page_id, translate(raw, '{url_rules.UPPER}', '{url_rules.LOWER}') AS host, path FROM parts)
        SELECT page_id, host, path,
            CASE {_FITS.format(*(f"'{host}{path}'" for host, path, _ in _RULES))} END AS rule,
            CASE {_FITS.format(*(f"'{verdict}'" for *_, verdict in _RULES))} ELSE 'allow' END AS verdict
        FROM lowered""",
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), taught AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
            FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
            FROM texts LEFT JOIN taught USING (doc_id)
        ), cells AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask
        ), letters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (
            SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step])::INTEGER AS after, list_sum(bits[:step])::INTEGER - bits[step] AS before
            FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step)
        ), found AS (
            SELECT part, filter_order, step, substr(filter_order, step, 1) AS filter,
                sum(CASE WHEN mask & after = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, substr(filter_order, step, 1)
        )
        SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM found""",
    "op13_importance": rf"""
        WITH crc_table AS (
            SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crcs
            FROM (SELECT unnest(range(256)) AS n)
        ), corpus AS (
            SELECT doc_id, unnest({{words}}) AS word FROM documents
        ), target AS (
            SELECT unnest({{words}}) AS word FROM benchmark
        ), spelt AS (
            SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes
            FROM (SELECT word FROM corpus UNION SELECT word FROM target)
        ), hashed AS (
            SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket
            FROM spelt, crc_table
        ), s AS (SELECT bucket, count(*) AS s FROM corpus JOIN hashed USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln(
                (coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {importance.BUCKETS})::DOUBLE
                / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain
            FROM s FULL JOIN t USING (bucket)
        ), sums AS (
            SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gain
            FROM corpus JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
        ), weights AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features,
                coalesce(floor(gain::DOUBLE / n_features), 0)::BIGINT AS weight,
                ('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8))::BIGINT AS h
            FROM documents LEFT JOIN sums USING (doc_id)
        ), scores AS (
            SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score,
                n_features >= {importance.LEAST_WORDS} AS able
            FROM weights
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scores
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {importance.PERCENT} * n // 100 THEN place END AS rank
        FROM ranked""".replace("{words}", _WORDS),
}
