"""A training corpus from raw documents: quality, language, near duplicates, mix, packed sequences.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import language, mixing, ngram_join, packing, quality
from loomline.plans.ordered import with_position
from loomline.session import materialize, materialize_some
from loomline.tables import load

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts go (no words); repeated rows and ids are judged each for itself."""
    return quality.quality_rules(docs).filter("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose spans lie in a known language, one or several; texts that are null, without letters or in none go
    (``und``). A missing label is filled by the prediction; repeated rows and ids are judged each for itself."""
    found = language.identify(docs, language.learn(docs, ~language.held_out()))
    return found.filter(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def _nodes(docs: DataFrame) -> DataFrame:
    """The rows with ``_node``, one number for each distinct (id, text): the id where only one text has it, else a number
    beyond all ids. Only ids that are missing or shared by several texts are numbered, so texts are usually not shuffled."""
    keyed = docs.select("*", F.coalesce(F.md5("text"), F.lit("")).alias("_key"))
    texts = keyed.groupBy("doc_id").agg(F.min("_key").alias("_a"), F.max("_key").alias("_z"), F.max("doc_id").alias("_most"))
    shared = texts.filter("doc_id IS NULL OR _a <> _z").select(F.col("doc_id").alias("_id"))
    unclear = keyed.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct()
    unclear, some = materialize_some(unclear, "unclear")
    if not some:
        return keyed.select(*COLUMNS, F.col("doc_id").cast("long").alias("_node"))
    most = docs.agg(F.max("doc_id").alias("n")).first().n or 0
    numbers = with_position(unclear, [F.col("_id").asc_nulls_last(), "_k"], "_number", start=most + 1)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    return keyed.join(numbers, same, "left").select(*COLUMNS, F.coalesce("_number", F.col("doc_id").cast("long")).alias("_node"))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; different texts are different documents even if
    they share an id or have none, and come after those with an id of their own (ids are below 2^62). Of equal rows one
    stays, of rows with the same id and text the first by source, language and length. Null and empty texts link with nothing."""
    nodes = _nodes(docs.select(*COLUMNS))
    groups = ngram_join.ngram_jaccard_components(nodes, id_col="_node")
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_node")).distinct()
    kept = nodes.join(first, "_node", "left_semi")
    turn = F.row_number().over(Window.partitionBy("_node").orderBy("source", "lang", "n_chars"))
    return kept.withColumn("_turn", turn).filter("_turn = 1").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each time. Documents without words have none to give and go;
    a null source is a source of its own; repeated rows are documents each for itself."""
    mixed = mixing.mixed_texts(mixing.mix(docs, keep=("text", "lang")))
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the sequences, and digests of their token ids. Null and empty texts are
    their end mark; repeated rows are packed each for itself."""
    pieces = packing.token_pieces(docs)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, salt=["doc_id", "start", "ids_crc32"])


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
