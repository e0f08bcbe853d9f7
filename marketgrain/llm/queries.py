"""One query for each operator of the subpackage, over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm.oracles import ORACLE_SQL  # noqa: F401
from marketgrain.llm.shared import settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.packing import pack_documents

    return settled(spark, lambda: pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 1024, 2), "packing")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.neardups import near_duplicates

    return settled(spark, lambda: near_duplicates(_table(spark, sf_dir, "documents")), "near-dedup")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.decontaminate import decontaminate

    found = settled(spark, lambda: decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")), "decontamination")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_license_scan, over documents that hold whole license texts: every document of which the number fits one of the known texts stands beside a
    copy of it with a title, a copyright line, other case, punctuation, spelling and line ends."""
    from marketgrain.llm.licenses import copies_of_texts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _licenses(docs.unionByName(copies_of_texts(docs)))


def _licenses(docs: DataFrame) -> DataFrame:
    from marketgrain.llm.licenses import known_licenses, license_scan

    def scanned() -> DataFrame:
        found = license_scan(docs, known_licenses(docs.sparkSession))
        return found.select("doc_id", "text_sha256", "license", "n_license_lines", F.array_join("line_licenses", ",").alias("line_licenses"))

    return settled(docs.sparkSession, scanned, "licenses")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.sstable import read_shards, write_shards

    manifest = write_shards(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2)
    read = read_shards(manifest)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.quality import quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_severity", "grade", "toxic", (~F.col("toxic")).alias("kept"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Names that the URL lists are about, at any label of a host.
LISTED_NAMES = r"(^|\.)(adult-x|casino-win|free-bets|cheap-pills|spam-farm|ads-track)\."


def listed_urls(pages: DataFrame) -> DataFrame:
    """A list as others keep it: pages of the listed names spelt in their own way (scheme, ``WWW.``, a slash, a tracking
    parameter, no fragment), and as many URLs of these hosts that no page has."""
    from marketgrain.llm.urls import host_of

    url = F.regexp_replace("url", "#.*$", "")
    named = pages.where(host_of(F.col("url")).rlike(LISTED_NAMES)).select(F.regexp_replace(url, r"(?i)^[a-z]+://((www|m)\.)?", "HTTPS://WWW.").alias("url"))
    slashed = F.regexp_replace("url", r"^([^?]*)", "$1/")
    spelt = named.select(F.concat(slashed, F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_source=list")).alias("url"))
    return spelt.unionByName(named.select(F.regexp_replace("url", r"^([^?]*)", "$1/gone").alias("url")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.urls import url_filter

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return settled(spark, lambda: url_filter(pages, listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict"), "urls")


def op8_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_url_filter, with the list spelt as the pages are."""
    from marketgrain.llm.urls import host_of, url_filter

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).rlike(LISTED_NAMES)).select("url")
    return settled(spark, lambda: url_filter(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict"), "urls")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.warc import page_id_of, read_warc, write_pages

    path = write_pages(_table(spark, sf_dir, "pages"))
    read = read_warc(spark, path)
    response = F.col("record_type") == "response"
    return read.select(
        page_id_of("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        page_id_of("refers_to").alias("refers_to"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.substrings import remove_repeats

    return settled(spark, lambda: remove_repeats(_table(spark, sf_dir, "documents"), with_text=False), "substring-dedup")


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.mtree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marketgrain.llm.lexical import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_near_dedup, op3_decontamination, op4_license_scan, op4_license_texts, op5_token_shards, op6_quality_rules, op7_toxicity, op8_url_filter, op8_url_list, op9_warc, op10_substring_dedup, op11_top_k, op12_whitening, op13_ranked_search)
}
