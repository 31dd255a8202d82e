"""One query for each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import ann, chat_format, html_extract, license_scan, license_texts, mixing, packing, quality_model, quality_rules, simhash, url_filter
from sextant.session import table

URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
QUERY_STEP = 20
EXTRA_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents"), [*license_scan.NOTICES, *license_texts.templates()])


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.select("doc_id", (quality_model.fold(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(rows))


def op10_ann(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0)).select("query_id", "rank", "vec_id", "score")


def _op1_sql() -> str:
    """Exact containment over the same windows, without signatures."""
    found = license_scan.tiers(license_scan.NOTICES)
    shingled = [
        f"h{size} AS MATERIALIZED (SELECT doc_id, list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) AS h FROM tokens WHERE len(w) >= {size})"
        for size in sorted({t.size for t in found})
    ]
    parts = []
    for tier in found:
        for name, shingles in tier.templates:
            listed = ", ".join("'" + s.replace("'", "''") + "'" for s in shingles)
            parts.append(f"""
            SELECT doc_id, '{name}' AS license_id, s AS start, len(list_intersect([{listed}], list_distinct(h[s + 1:s + {tier.window}]))) / {len(shingles)}::DOUBLE AS containment
            FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) - 1 - {tier.window - tier.stride}) + 1, {tier.stride})) AS s FROM h{tier.size} WHERE list_has_any(h, [{listed}]))""")
    return f"""
        WITH tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        {", ".join(shingled)},
        found AS ({" UNION ALL ".join(parts)}),
        matched AS (SELECT * FROM found WHERE containment >= {license_scan.SIMILARITY}),
        best AS (SELECT doc_id, license_id, max(containment) AS containment FROM matched GROUP BY ALL)
        SELECT b.doc_id, b.license_id, b.containment, min(m.start)::BIGINT AS first_word
        FROM best b JOIN matched m ON m.doc_id IS NOT DISTINCT FROM b.doc_id AND m.license_id = b.license_id AND m.containment = b.containment
        GROUP BY ALL"""


def _op3_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
        WITH cut AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        parts AS (SELECT n, page_id,
            coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
        rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
        fits AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)"""


def _op6_sql() -> str:
    return """
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS hash, row_number() OVER () AS n FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sources),
        weighted AS (SELECT *, [3.0, 1.0, 2.0][(source_rank - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
        levelled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
            FROM weighted WINDOW below AS (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        water AS (SELECT arg_min(level, (cap / weight, source_rank)) AS water FROM levelled WHERE cap >= level * weight),
        targets AS (SELECT source, source_rank, source_size, coalesce(least(cap, water * weight), cap) AS target FROM levelled LEFT JOIN water ON true),
        sent AS (SELECT s.*, source_rank, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        copies AS (SELECT *, (sent + c * source_size)::DOUBLE / target AS finish FROM sent, (VALUES (0), (1)) AS v(c) WHERE size > 0 AND target > 0),
        running AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, hash, doc_id, size, c ROWS UNBOUNDED PRECEDING) AS running FROM copies),
        budget AS (SELECT least(1.5::DOUBLE * sum(source_size), 2.0::DOUBLE * sum(source_size)) AS budget FROM sources),
        taken AS (SELECT n, count(*) AS copies FROM running, budget WHERE running <= budget GROUP BY n)
        SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM sent LEFT JOIN taken USING (n)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_simhash, op3_url_filter, op4_quality_rules, op5_quality_model, op6_mixing, op7_html_extract, op8_packing, op9_chat_format, op10_ann)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    return {"op1_license_scan": _op1_sql(), "op3_url_filter": _op3_sql(), "op6_mixing": _op6_sql()}
