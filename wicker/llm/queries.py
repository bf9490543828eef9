"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wicker.llm import pii, quality, secret_scan, sql, toxicity
from wicker.llm.bpe import decode_documents, encode_documents
from wicker.llm.decontaminate import LeakParams, find_leaks
from wicker.llm.encode import default_tokenizer, word_tokenizer
from wicker.llm.near_dup import near_duplicates
from wicker.llm.packing import encode_pieces, place
from wicker.llm.pii import find_pii
from wicker.llm.resample import ResampleParams, resample
from wicker.llm.secret_scan import scan_secrets
from wicker.llm.spelling import SpellingParams, spelling_variants, words_of_texts
from wicker.llm.token_counts import length_counts, length_histogram
from wicker.llm.token_files import read_documents, write_token_files
from wicker.llm.vptree import build_index, search
from wicker.plans.registry import query
from wicker.session import new_folder, stage_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to flat binary files and read back from them."""
    corpus = write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), default_tokenizer())
    return read_documents(spark, corpus)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids; a digest stands for the ids."""
    pieces = encode_pieces(table(spark, sf_dir, "documents"), default_tokenizer(), 2048)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 2048)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with suffix sums."""
    counts = length_counts(table(spark, sf_dir, "documents"), default_tokenizer())
    return length_histogram(stage_table(counts, "length_counts"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id and the size of its near-duplicate class."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and a digest of the base kinds, and all spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return digest(found, pii.BASE)


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents through a new ledger: counts and a digest of the base kinds, and all spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"), new_folder(spark, "secret_ledger"))
    return digest(found, secret_scan.BASE)


def digest(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans, from (doc_id, spans)."""
    counts = [F.size(pii.of_kinds(F.col("spans"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    own = pii.joined(pii.of_kinds(F.col("spans"), base))
    return found.select("doc_id", *counts, F.sha2(own.cast("binary"), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def apart(labels: DataFrame, parts: int, held: int) -> DataFrame:
    """Labels of the rows to learn from: those outside the held-out remainder."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != held)


def judged(scores: DataFrame, parts: int, held: int) -> DataFrame:
    """Adds held_out and predicted, from 0.3 on."""
    return scores.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for quality by attention over their passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, apart(table(spark, sf_dir, "labels"), 5, 0))
    return judged(quality.score_quality(docs, model), 5, 0)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored for toxicity by a lexicon learnt from labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn_lexicon(docs, apart(table(spark, sf_dir, "labels"), 4, 2))
    return judged(toxicity.score_toxicity(docs, lexicon), 4, 2)


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the item, the place and the similarity."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), LeakParams(short_items=True))


@query("op4_vantage_point_trees")
def op4_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    index = build_index(vectors, new_folder(spark, "trees"))
    return search(index, vectors.where(F.col("vec_id") % 50 == 0), 5)


@query("op11_spelling_variants", sql.SPELLING)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some with a letter lost, with their near words, forms and roots."""
    p = SpellingParams(noise=31)
    return spelling_variants(words_of_texts(table(spark, sf_dir, "documents"), p), p)


@query("op12_importance_resampling", sql.RESAMPLING)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed by their likeness to the benchmark, a tenth of the longer ones drawn."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ResampleParams())
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_bpe_codec")
def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with the word vocabulary and decoded again: digests of the ids and of the text."""
    path = word_tokenizer()
    encoded = encode_documents(table(spark, sf_dir, "documents"), path)
    digests = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    decoded = decode_documents(digests, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another, over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
