"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm import (
    language,
    lexical,
    mixing,
    neighbours,
    ngrams,
    packing,
    periodic,
    pieces,
    piecewise,
    simhash,
    template,
    toxicity,
    warc,
)
from tallyscope.llm.common import WORD, checksum, read, remainder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(remainder("doc_id", 5) != 0))
    return language.identified(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_records(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 10) == 0)
    model = ngrams.train(docs.where(~F.col("held_out")))
    return ngrams.scored(docs, model).select(
        "doc_id",
        (remainder("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = piecewise.edited(read(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        piecewise.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        piecewise.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extracted(read(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(remainder("doc_id", 5) != 0), read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document in ten by the checksum of its id repeats a stretch of its words to its end."""
    word = f"regexp_extract_all(text, '{WORD}', 0)".replace("\\", "\\\\")
    marked = docs.select("doc_id", "text", checksum("doc_id").alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.expr(word))
    )
    n = F.size("words")
    placed = marked.withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        "a", F.when(n > 0, F.col("g") % n)
    )
    first = (F.col("a") + 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).alias("until")
    repeated = F.expr(
        "concat(slice(words, 1, int(a)), transform(sequence(int(a), size(words) - 1), "
        "i -> words[int(a + (i - a) % (until - a))]))"
    )
    planted = placed.select("doc_id", "text", "words", "a", first)
    return planted.select(
        "doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")
    )


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.col2")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.col3")).alias("period"),
        F.expr("(1000 * longest.length) DIV (-longest.col3)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encoded(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees",
    )


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_warc": op2_warc,
    "op3_ngrams": op3_ngrams,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_piecewise": op6_piecewise,
    "op7_neighbours": op7_neighbours,
    "op8_template": op8_template,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_periodic": op11_periodic,
    "op12_lexical": op12_lexical,
    "op13_pieces": op13_pieces,
}
