"""The queries that apply the operators of this folder to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from supportlens.llm import (
    alignment,
    chat_format,
    exact_dedup,
    html_text,
    mixing,
    near_dedup,
    packing,
    quality,
    secret_scan,
    sharding,
    spelling,
    url_filter,
    warc,
)
from supportlens.llm.tokens import piece_vocabulary
from supportlens.llm.common import table
from supportlens.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rules (host, path, verdict) that the url query applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: A conversation whose texts hold control strings, added to the table.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def hashed_groups(groups: str) -> Column:
    """The digest of the groups; none where there are none."""
    return F.when(F.col(groups) == "", "").otherwise(F.sha2(groups, 256))


def _query(sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(apply_settings(spark), sf_dir)
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


@_query(
    """
    WITH texts AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    ), groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM texts JOIN groups USING (t)
    """
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_query()
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@_query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@_query()
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_versions(table(spark, sf_dir, "documents"))
    counts = [
        secret_scan.count_of(F.col("findings"), kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS
    ]
    base = secret_scan.listed(F.col("findings"), secret_scan.BASE_KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("findings")).alias("spans")
    )


@_query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@_query(
    """
    WITH parts AS (
      SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path
      FROM pages
    )
    SELECT page_id, host, path,
      CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
           WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
           WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
           WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
           WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
      CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'allow'
           WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'block'
           WHEN ('.' || host) LIKE '%.net' AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
           ELSE 'allow' END AS verdict
    FROM parts
    """
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@_query(
    r"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized AS (
      SELECT *, length(text)
        + len(regexp_extract_all(text, '<␛*(?:<SYS>>|</SYS>>|s>|/s>|\|role\|>|\|text\|>|\|end\|>)'))
        + len(regexp_extract_all(text, '\[␛*/?INST\]'))
        + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                    ELSE length(role) + 24 END AS n
      FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(n)::BIGINT AS formatted_chars,
      bool_and(in_order) AS in_order
    FROM (
      SELECT *, CASE coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '')
        WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
        WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE FALSE END AS in_order
      FROM sized
    )
    GROUP BY conv_id
    """
)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = chat_format.conversations(chat_format.format_turns(given.unionByName(added)))
    turns = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learned = F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat_format.unescaped(s.text))
    return (
        chats.withColumn("turns", chat_format.read_back(F.col("formatted")))
        .withColumn("learned", F.array_join(learned, ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.char_length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "in_order",
        )
    )


@_query()
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@_query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@_query(
    r"""
    WITH docs AS (
      SELECT doc_id, source, coalesce(text, '') AS t,
        CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS source_key
      FROM documents
    ), sized AS (
      SELECT doc_id, source, source_key,
        len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':20'), 1, 12))::BIGINT + 0.5::DOUBLE)
            / 281474976710656::DOUBLE)
          / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * len(regexp_extract_all(t, '[#*$%&|<>]'))
                            / greatest(length(t), 1))) AS rank_key
      FROM docs
    ), sources AS (
      SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key
    ), weighed AS (
      SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source_key) - 1) % 3 + 1]::DOUBLE AS weight,
        source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS words
      FROM sources
    ), levels AS (
      SELECT *,
        (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_key
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source_key
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM weighed
    ), targets AS (
      SELECT source_key, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
    ), placed AS (
      SELECT *, sum(size) OVER (PARTITION BY source_key ORDER BY rank_key, doc_id NULLS FIRST, size
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
      FROM sized JOIN targets USING (source_key)
    )
    SELECT doc_id, size, source_size, target,
      (size * (epochs + (CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size)
                              THEN 1 ELSE 0 END)))::BIGINT AS taken
    FROM placed
    """
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = alignment.links(table(spark, sf_dir, "documents"), vocabulary(), pieces())
    named = linked.withColumn("groups_sha256", hashed_groups("groups")).drop("groups")
    scored = alignment.with_counts(named, piece_vocabulary(pieces()).size)
    return scored.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@_query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = spelling.spelling_variants(table(spark, sf_dir, "documents"))
    return variants.select("word", "form", "root", "n", "n_near", "form_n")


@_query(
    """
    WITH payloads AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n FROM pages),
    held AS (SELECT t, max(page_id) AS holder FROM payloads WHERE n >= 1000 GROUP BY t)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(t) AS payload_digest,
      CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
    FROM payloads LEFT JOIN held USING (t)
    """
)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(files, payloads=False).where("record_type IS DISTINCT FROM 'warcinfo'")
    broken = F.raise_error(F.concat_ws(" ", "fault", "path", "offset"))
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(broken).alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )
