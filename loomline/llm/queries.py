"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from loomline.catalog.registry import registry
from loomline.llm import decontamination, fingerprints, language, lexical_search, licenses, mixing, ngram_join, packing, prefix_trie, quality, sharding, token_files, warc
from loomline.session import scratch_path
from loomline.tables import load

QUERIES, ORACLES, query = registry()


@query("op1_sharding")
def op1_sharding(spark, sf_dir):
    placed = sharding.shard_documents(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_ngram_join", ngram_join.oracle())
def op2_ngram_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_components(load(spark, sf_dir, "documents"))


@query("op3_quality_rules", quality.oracle())
def op3_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_warc")
def op4_warc(spark, sf_dir):
    files = warc.write_archives(load(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    read = warc.read_archives(spark, [name for name, _ in files])
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    pieces = packing.token_pieces(load(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, salt=["doc_id", "start", "ids_crc32"])


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = language.learn(docs, ~language.held_out())
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op7_fingerprints")
def op7_fingerprints(spark, sf_dir):
    return fingerprints.digests(fingerprints.near_neighbours(load(spark, sf_dir, "documents")))


@query("op8_license_scans", licenses.oracle())
def op8_license_scans(spark, sf_dir):
    scanned = licenses.license_scan(load(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    files = token_files.write_token_files(load(spark, sf_dir, "documents"), scratch_path(spark, "tokens"))
    return token_files.read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op11_lexical_search", lexical_search.oracle())
def op11_lexical_search(spark, sf_dir):
    found = lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


@query("op12_prefix_trie", prefix_trie.oracle())
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(load(spark, sf_dir, "conversations"))


@query("op13_decontamination", decontamination.oracle())
def op13_decontamination(spark, sf_dir):
    return decontamination.digests(decontamination.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
