"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align as _align
from . import decontaminate as _decontaminate
from . import katz as _katz
from . import langid as _langid
from . import licenses as _licenses
from . import mix as _mix
from . import near as _near
from . import quality as _quality
from . import shard as _shard
from . import tokenids as _tokenids
from . import toxicity as _toxicity
from . import vectors as _vectors
from . import warc as _warc
from .workspace import Workspace

#: Mean log ratio per feature that a document needs. Trusted text is about 0 or above; symbols, tables and repeats are at -0.2 and less.
QUALITY = -0.12


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents, learning from those whose remainder mod 7 is not 2."""
    return _katz.score(_docs(spark, sf_dir), Workspace(spark, "op1"), _remainder(7) == 2)


def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each license template in all documents."""
    return _licenses.scan(_docs(spark, sf_dir), Workspace(spark, "op2"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents for toxicity, learning from labels whose remainder mod 5 is not 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    docs = _docs(spark, sf_dir)
    model = _toxicity.fit(_toxicity.sample(docs, labels, train=_remainder(5) != 0))
    out = _toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "n_above")


def tokenizer_path() -> str:
    """The vocabulary file of the public tokenizer that op4 and the pipeline write ids of."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as range-coded files and read them back."""
    ws = Workspace(spark, "op4")
    return _tokenids.read(_tokenids.write(_docs(spark, sf_dir), ws, tokenizer_path()), ws)


def op5_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents, learning from those whose remainder mod 5 is not 0."""
    docs = _docs(spark, sf_dir)
    model = _langid.fit(_langid.sample(docs.select("doc_id", "text", "lang"), train=_remainder(5) != 0))
    out = _langid.label(docs, model, pass_on=["doc_id"])
    return out.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents; sources weigh 3, 1, 2, repeating, and share 150% of all words, each at most twice its own."""
    return _mix.mix(_docs(spark, sf_dir), Workspace(spark, "op6")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents, for word 5-grams and a similarity of 0.8."""
    return _near.join(_docs(spark, sf_dir), Workspace(spark, "op7")).select("doc_id", "class_id", "class_size", "n_links", "keep")


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find windows of 10 words of all benchmark items in all documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = _decontaminate.decontaminate(_docs(spark, sf_dir), items, Workspace(spark, "op8"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op9_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate all documents; the trusted target is the documents whose label has quality 1."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    out = _quality.assess(_docs(spark, sf_dir), trusted, Workspace(spark, "op9"), threshold=QUALITY)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into shards 0 to 23 under the law `rows`."""
    out = _shard.shard(_docs(spark, sf_dir), Workspace(spark, "op10"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages as WARC records, compressed with a dictionary each archive, and read them back."""
    archives = _warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), Workspace(spark, "op11"))
    return _warc.read(archives).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align the tokens of two public tokenizers in all documents."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    out = _align.align(_docs(spark, sf_dir), Workspace(spark, "op12"), lambda: _align.byte_coder(a), lambda: _align.piece_coder(b), keys=["doc_id"], groups=lambda df: df.withColumn("groups", digest)).docs
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code all embeddings in 4 parts, with 256 entries each and 4 rounds."""
    out = _vectors.quantise(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Workspace(spark, "op13"))
    return out.codes.select("vec_id", "code", "error", "label_error", F.lit(out.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_backoff": op1_katz_backoff,
    "op2_license_windows": op2_license_windows,
    "op3_compression_toxicity": op3_compression_toxicity,
    "op4_range_coded_ids": op4_range_coded_ids,
    "op5_crf_language": op5_crf_language,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_positional_index": op8_positional_index,
    "op9_likelihood_ratio": op9_likelihood_ratio,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_warc_dictionary": op11_warc_dictionary,
    "op12_token_alignment": op12_token_alignment,
    "op13_yinyang_codes": op13_yinyang_codes,
}

#: DuckDB SQL for the queries that SQL can express: the others hash, code, learn or iterate.
ORACLES: dict[str, str] = {
    # what the archives must say when read back
    "op11_warc_dictionary": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
        FROM g
    """,
}
