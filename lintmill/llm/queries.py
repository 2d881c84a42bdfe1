"""The operators as registered queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintmill.llm import toxicity
from lintmill.llm.bpe import Bpe, ids_digest, read_ranks
from lintmill.llm.common import table
from lintmill.llm.decontaminate import covered, find_hits
from lintmill.llm.html_extract import extract_text
from lintmill.llm.language_id import held_out, identify, train
from lintmill.llm.ngram_join import join_components
from lintmill.llm.pii import KINDS, find_spans, spans_text
from lintmill.llm.prefix_trie import hash_turns, rebuild, trie
from lintmill.llm.quality_rules import judge_quality
from lintmill.llm.spelling import group_variants
from lintmill.llm.substring_dedup import find_repeats, words_in
from lintmill.llm.url_filter import judge_urls
from lintmill.llm.warc import page_facts, round_trip

URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_paragraphs",
        words_in(F.col("repeated")).alias("n_repeated_words"),
        words_in(F.col("removed")).alias("n_removed_words"),
        (F.size("repeated") > 0).alias("repeats"),
        spans.alias("removed_spans"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def bpe(spark: SparkSession) -> Bpe:
    import public_tokenizers

    return Bpe(spark, read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(spark).encode(table(spark, sf_dir, "documents").select("doc_id", "text"), back=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).drop("key", "root")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts(round_trip(table(spark, sf_dir, "pages")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = hash_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    return trie(*rebuild(turns, F.crc32(conv.cast("string").cast("binary")) % 6, conv - conv % 100))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_pii": op8_pii,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_toxicity": op12_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}
