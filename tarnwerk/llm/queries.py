"""Queries over the training-data operators, each over whole tables, and their SQL where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licenses, media, packing, quality, sentencepieces, suffixes, superminhash, toxicity, urlrules, wordpieces
from .workspace import spread

#: Fixed values of the URL filter's contract: verdict, host, path.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, path) if name == "documents" else df


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.texts_as_images(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.cut_repeats(table(spark, sf_dir, "documents"), gram=suffixes.PASSAGE_GRAM, passage=suffixes.PASSAGE)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark, URL_RULES))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("found", lambda x: F.struct(x["coverage"].alias("coverage"), x["matched"].alias("matched"), x["template"].alias("template"), x["first_byte"].alias("first_byte"), x["end_byte"].alias("end_byte"))))
    return found.select("doc_id", F.size("found").cast("long").alias("n_stretches"), best.alias("b"), "found").select("doc_id", "n_stretches", F.col("b.template").alias("template"), F.round("b.coverage", 6).alias("coverage"), F.col("b.matched").cast("long").alias("matched_words"), F.col("b.first_byte").alias("first_byte"), F.col("b.end_byte").alias("end_byte"), "found")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepieces.encoded(table(spark, sf_dir, "documents"), piece_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), "parity")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), wordpieces.word_encoder(word_tokenizer()))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.expand(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_dedup, op2_quality_rules, op3_media_columns, op4_suffix_dedup, op5_url_filters, op6_toxicity, op7_license_scans, op8_sentencepiece, op9_best_fit_packing, op10_chat_formatting)
}

ORACLE_SQL: dict[str, str] = {
    "op5_url_filters": """
        with rules(verdict, rule_host, rule_path) as (values
                ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        cut as (
            select page_id,
                   case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
            from pages),
        split as (
            select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
            from cut),
        best as (
            select host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule,
                   max_by(verdict, length(rule_host || rule_path)) as verdict
            from (select distinct host, path from split)
            join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
            group by host, path)
        select s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') as verdict
        from split s left join best b on s.host = b.host and s.path = b.path""",
}
