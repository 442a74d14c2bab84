"""Registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from termsheet.llm import common, decontam, langid, merkle, mixture, oracles, pii, rules, shards, simhash, spans, suffixes, tokens, toxicity, trie

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(common.tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op7_interleave", oracles.OP7)
def op7_interleave(spark, sf_dir):
    text = common.text_or_empty().cast("binary")
    rows = common.table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shards.interleave(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_quality_rules", oracles.op9())
def op9_quality_rules(spark, sf_dir):
    judged = rules.risk_controlled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


@query("op5_simhash_trie")
def op5_simhash_trie(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    return toxicity.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op1_decontaminate")
def op1_decontaminate(spark, sf_dir):
    return decontam.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op8_mixture")
def op8_mixture(spark, sf_dir):
    return mixture.taken(common.table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    counted = tokens.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op6_sentence_spans", oracles.op6())
def op6_sentence_spans(spark, sf_dir):
    found = spans.dedup(common.table(spark, sf_dir, "documents"))
    size = lambda c: F.octet_length(c).cast("long")
    return found.select("doc_id", size("text").alias("n_bytes"), (size("text") - size("kept")).alias("n_removed"),
                        F.col("n_removed").cast("long").alias("n_removed_sentences"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_language")
def op4_language(spark, sf_dir):
    return langid.classify(common.table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    found = suffixes.dedup(common.table(spark, sf_dir, "documents"))
    size = lambda c: F.octet_length(c).cast("long")
    return found.select("doc_id", size("text").alias("n_bytes"), (size("text") - size("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_merkle", oracles.op13())
def op13_merkle(spark, sf_dir):
    return merkle.manifest(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op11_pii")
def op11_pii(spark, sf_dir):
    found = pii.find(common.table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.sort_array(F.concat("base", "added"))).alias("spans"))


@query("op12_trie", oracles.OP12)
def op12_trie(spark, sf_dir):
    return trie.nodes(common.table(spark, sf_dir, "conversations"))
