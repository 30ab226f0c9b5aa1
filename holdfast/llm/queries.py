"""The queries of this subpackage over a folder with the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import byte_pairs, hilbert_search, language, minhash_dedup, packing, periodic_runs, quality_classifier, quality_rules, ranked_search, shingle_join, suffix_dedup, surrogates, token_files
from holdfast.llm.tables import documents
from holdfast.llm.texts import TEXTS

END_ID = 2
NEAREST, QUERY_STEP = 20, 20
# A sample key; a user passes a secret one.
SURROGATE_KEY = "sample key"


def crc_remainder(column: str, divisor: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read(shards).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), NEAREST, QUERY_STEP)


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.joined(documents(spark, sf_dir))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(packing.packed_documents(documents(spark, sf_dir), tokenizer, END_ID, ids=False), ids=False)


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_pairs.digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    learning = docs.select("doc_id", "text", "n_chars").where(~held_out).join(labels, "doc_id")
    scores = quality_classifier.scored(docs, quality_classifier.fit(learning))
    return scores.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_remainder("doc_id", 4) == 2
    named = language.self_identified(docs, ~held_out, ["doc_id"])
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the last words of a tenth of the texts repeat with a period that the id gives."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.when(h % 10 == 0, F.col("text")), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    g, n = F.floor(h / 10), F.size("words")
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("words")).withColumn("a", (F.col("g") % n).cast("int"))
    behind = n - F.col("a")
    sized = cut.withColumn("p", (1 + F.floor(behind / (3 + F.col("g") % 8))).cast("int"))
    once = F.slice("words", F.col("a") + 1, F.col("p"))
    often = F.flatten(F.array_repeat(once, F.ceil(behind / F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(often, F.lit(1), behind)), " ")
    return sized.select("doc_id", F.when(F.size("words") > 0, changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(with_planted_runs(documents(spark, sf_dir)))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select("doc_id", "runs", "collapsed", longest.alias("longest")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op2_surrogates": op2_surrogates,
    "op1_quality_rules": op1_quality_rules,
    "op3_token_files": op3_token_files,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_hilbert_search": op5_hilbert_search,
    "op6_shingle_join": op6_shingle_join,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_byte_pairs": op8_byte_pairs,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language": op10_language,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_minhash_dedup": op13_minhash_dedup,
}

__all__ = ["QUERIES", "TEXTS"]
