"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_texts, load_ranks
from .common import read
from .cotraining import classify_quality
from .decision_list import apply_rules
from .line_dedup import dedup_lines, line_dedup_sql
from .ngram_join import shingle_components, shingle_components_sql
from .secret_scan import find_secrets, scan_digest, secrets_sql
from .packing import pack_documents, word_tokenizer
from .sharding import assign_shards, sharding_sql
from .telephony import digest_media, store_texts
from .url_filter import HostRule, filter_urls

#: Shard names of the sharding query.
SHARDS = [f"shard-{i:02d}" for i in range(64)]


#: Rules of the URL query.
URL_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Labelled URLs: a host with one of these words is a known bad one, the others are the background.
BAD_HOST_WORDS = ("casino", "pills", "bets", "ads", "track", "spam", "adult", "porn")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", SHARDS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, whole_runs=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    label = F.col("host").rlike("(^|[.-])(" + "|".join(BAD_HOST_WORDS) + ")([.-]|$)").cast("int")
    return filter_urls(pages, URL_RULES, label).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(store_texts(read(spark, sf_dir, "documents")))


def op6_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_digest(find_secrets(docs))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, read(spark, sf_dir, "labels"))[0].select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, word_tokenizer(spark, tokenizer_path("word_bpe_49k.json")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, load_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), PATTERN, arrays=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_sharding": op2_sharding,
        "op3_line_dedup": op3_line_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_telephony": op5_telephony,
        "op6_cotraining": op6_cotraining,
        "op7_secret_scan": op7_secret_scan,
        "op8_decision_list": op8_decision_list,
        "op9_packing": op9_packing,
        "op10_byte_bpe": op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": shingle_components_sql("documents"),
        "op2_sharding": sharding_sql("documents", "doc_id", "doc_id", SHARDS),
        "op3_line_dedup": line_dedup_sql("documents"),
        "op7_secret_scan": secrets_sql("documents"),
    }
