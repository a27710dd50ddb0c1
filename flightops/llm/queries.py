"""The registered queries of the corpus operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightops.llm import (
    decontaminate,
    language,
    merkle,
    mixing,
    near_dedup,
    pii,
    preference,
    resample,
    substring,
    token_counts,
    token_output,
    topk,
    url_filter,
)
from flightops.llm.common import session_for_scans, session_for_texts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    session_for_texts(spark)
    docs = table(spark, sf_dir, "documents")
    return token_output.read_tokens(spark, token_output.write_tokens(docs, tokenizer_path(), END_ID))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that are not held out."""
    session_for_texts(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, ("doc_id", "held_out"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group, on two-word shingles."""
    session_for_texts(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of every document stand in a window of which benchmark items."""
    session_for_scans(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and when first."""
    session_for_texts(spark)
    plan = mixing.schedule(table(spark, sf_dir, "documents"))
    taken = (F.size("positions") * F.col("size")).alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, F.get("positions", F.lit(0)).alias("first_position"))


@query
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same with a foreign ending: prompt and masked completions."""
    session_for_texts(spark)
    pairs = preference.with_foreign_ending(table(spark, sf_dir, "conversations"))
    out = preference.format_preferences(pairs)

    def shape(c: str) -> list[Column]:
        mask = F.array_join(F.transform(c, lambda s: F.concat(F.length(s.text).cast("string"), F.when(s.train, "+").otherwise("-"))), ",")
        return [F.array_join(F.transform(c, lambda s: s.text), "").alias(c), mask.alias(f"{c}_mask")]

    return out.select("pair_id", "prefix_turns", "prompt", *shape("chosen"), *shape("rejected"))


# Fixed values of the contract.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rule, or by a model trained on the labelled URL table."""
    session_for_texts(spark)
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


QUERY_EVERY, BEST = 50, 5  # fixed values of the contract


@query
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    session_for_texts(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.integers().alias("v"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), BEST)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that repeats an earlier one, and where the original is."""
    session_for_texts(spark)
    return substring.repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the patterns' spans counted, all spans listed."""
    session_for_texts(spark)
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, and its rank if it is drawn."""
    session_for_texts(spark)
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


COUNTED_TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 512


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens."""
    session_for_texts(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(COUNTED_TOKENIZER), TOKEN_LIMIT)


TAMPERED_EVERY = 5  # fixed values of the contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether its text, tampered with for one in five, still proves."""
    session_for_texts(spark)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0
    claim = F.when(tampered, merkle.leaf(F.translate("text", UPPER, LOWER)))
    manifest = merkle.build(table(spark, sf_dir, "documents"), claim)
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    found = merkle.proofs(manifest).withColumns({"root": root, "verified": F.col("folded_root") == root})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
