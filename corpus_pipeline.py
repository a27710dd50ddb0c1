"""From raw documents to token files: five stages, each written and read again by the next.

1. Language: documents whose language cannot be told, or where no language holds a third, go.
2. Near duplicates: one document of each group stays.
3. Decontamination: documents with a passage of the benchmark go.
4. Mixing: documents are repeated or left out so that sources meet their weights, in training order.
5. Tokens: ids in flat files, in the order of the mix; the result lists every copy and its place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.llm import decontaminate, language, mixing, near_dedup, token_output
from flightops.llm.common import session_for_texts, small, staged, table, text_hash

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LEAST_SHARE = 1 / 3
BROADCAST_ROWS = 2_000_000  # ids and hashes, 16 bytes each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows with a language; learned from the labelled rows that are not held out.

    Null and empty texts and texts without letters go. Only ids and hashes of the rows that go are written; the texts
    themselves stay in the JVM.
    """
    session_for_texts(spark)
    model = language.train(docs.filter(~language.held_out()))
    keyed = docs.select("doc_id", "text", text_hash().alias("text_key"))
    found = language.predict(keyed, model, ("doc_id", "text_key"))
    gone = (F.col("lang_pred") == language.UNDETERMINED) | (F.col("score") < LEAST_SHARE)
    return without(docs, staged(found.filter(gone).select("doc_id", "text_key").distinct(), "gone"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose id and text are not in gone (doc_id, text_key)."""
    gone = small(gone.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key")), BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (text_hash() == F.col("__key"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of five-word near duplicates.

    Where several rows have that id, the row whose text has the smallest hash stays, once.
    """
    session_for_texts(spark)
    groups = staged(near_dedup.near_duplicates(docs, size=5), "groups")
    kept = groups.filter("kept and doc_id is not null").groupBy("doc_id")
    kept = kept.agg(F.count("*").alias("rows"), F.min("text_key").alias("first"))
    several = staged(kept.filter("rows > 1"), "several")
    again = groups.join(several, "doc_id", "left_semi")
    gone = groups.filter(~F.col("kept")).unionByName(again).select("doc_id", "text_key").distinct()
    rest = without(docs, staged(gone, "gone"))
    if not several.limit(1).count():
        return rest
    once = docs.join(several.select(F.col("doc_id").alias("__doc"), "first"), (F.col("doc_id") == F.col("__doc")) & (text_hash() == F.col("first")))
    return rest.unionByName(once.select(*docs.columns).dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that hold no window of ten words of a benchmark item."""
    session_for_texts(spark)
    runs = staged(decontaminate.windows(table(spark, sf_dir, "benchmark")), "runs")
    hit = decontaminate.occurrences(docs, runs).select("doc_id", "text_key").distinct()
    return without(docs, staged(hit, "hit"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out rows so that sources meet their targets, range-sorted by training position."""
    session_for_texts(spark)
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the ids in the order in which the rows are stored and list every document's place."""
    session_for_texts(spark)
    stored = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    folder = token_output.write_tokens(docs, public_tokenizers.path(TOKENIZER), END_ID, order=stored)
    return token_output.read_tokens(spark, folder)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

# Language models and tokenizers are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    session_for_texts(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
