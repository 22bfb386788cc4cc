"""From documents to token ids: language, near copies, benchmark leaks, source weights, ids.

Each stage reads what its predecessor kept, as a table, and all but the last
return the columns of documents. Stages name a document by doc_id and the MD5 of
its text, so decisions are joined back without shuffling more than the text, and
equal rows share a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as _decontaminate
from graphloom.llm import langid, mix, near, tokenids
from graphloom.llm.registry import tokenizer_path
from graphloom.llm.workspace import Workspace

#: A document is in languages that were learned if its words are clear or familiar: text in them, switching or not, is above 0.87 and 0.95, other text below 0.7 and 0.8.
CLEAR, FAMILIAR = 0.75, 0.9
KEY = ["doc_id", "md5"]


def whole(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows of docs as one struct, `row`, and the columns `more`: whatever names docs has, none clashes with those that a stage makes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not `und`, and clear or familiar.

    Null and empty texts and those without a letter go; so does text in languages
    that lang doesn't name, or in none. Long texts are read whole; equal rows
    share a fate; an empty table stays empty. Without any lang all go.
    """
    model = langid.fit(langid.sample(docs.select("doc_id", "text", "lang")))
    out = langid.label(whole(docs), model, pass_on=["row"], inside="row")
    return out.where((F.col("lang_pred") != langid.UND) & ((F.col("lang_clear") >= CLEAR) | (F.col("lang_familiar") >= FAMILIAR))).select("row.*")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, the one of the least doc_id.

    Of rows equal in doc_id and text any one is kept; null ids come last. Null and
    empty texts are near to nothing and all stay. Long texts are compared whole;
    an empty table stays empty.
    """
    found = near.join(docs, Workspace(spark, "stage-near"))
    # of equal rows each is in the class; one of them is kept
    kept = found.groupBy(*KEY).agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("rows"), F.first("class_size").alias("class_size")).where("keep")
    single = F.col("class_size") == 1
    return by_key(docs, kept.select(*KEY, F.when(single, F.col("rows")).otherwise(F.lit(1)).cast("long").alias("copies"), "rows"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which any window of a benchmark item occurs.

    Null and empty texts have none and stay, as all do where benchmark is empty.
    Equal rows share a fate; long texts are searched whole.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select("doc_id", near.text_md5(), "text")
    hit = _decontaminate.decontaminate(keyed, items, Workspace(spark, "stage-leaks"), keys=KEY, reach=None).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("md5").alias("hit_md5")).distinct()
    out = whole(docs, F.col("doc_id").alias("id"), near.text_md5())
    return out.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("md5") == F.col("hit_md5")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their targets.

    Null and empty texts have no words, null sources are one source, the last.
    Rows equal in doc_id and text get the copies of all of them together. No
    document has more than twice its rows. An empty table stays empty.
    """
    out = mix.mix(docs.select("doc_id", near.text_md5(), "text", "source", "lang"), Workspace(spark, "stage-mix"), keys=KEY)
    return by_key(docs, out.groupBy(*KEY).agg(F.sum("copies").cast("long").alias("copies"), F.count(F.lit(1)).alias("rows")))


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as range-coded files; (doc_id, start, n_tokens, ids_crc32) read back from them.

    Null and empty texts have the end id only; equal rows are written each; other
    columns aren't read; an empty table gives no rows.
    """
    ws = Workspace(spark, "stage-ids")
    return tokenids.read(tokenids.write(docs, ws, tokenizer_path()), ws)


def by_key(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with `copies` rows for each key in all; decisions(doc_id, md5, copies, rows), where rows is how many rows of docs have the key.

    Rows of a key that occurs once, as nearly all do, are repeated as they are;
    of others, equal in doc_id and text, one is taken first.
    """
    some = decisions.where("copies > 0").select(F.col("doc_id").alias("to_id"), F.col("md5").alias("to_md5"), "copies", "rows")
    out = whole(docs, F.col("doc_id").alias("id"), near.text_md5())
    out = out.join(some, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("md5") == F.col("to_md5")))
    repeat = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    as_is = out.where("copies = rows").select("row")
    once = out.where("copies <> rows and rows = 1").select("row", repeat.alias("n")).select("row")
    # one of the rows of a key, whatever types they have
    many = out.where("copies <> rows and rows > 1").dropDuplicates(["to_id", "to_md5"]).select("row", repeat.alias("n")).select("row")
    return as_is.unionByName(once).unionByName(many).select("row.*")


STAGES = [
    ("language", keep_language),
    ("near copies", keep_one_of_near),
    ("benchmark leaks", drop_leaks),
    ("source weights", mix_sources),
    ("token ids", write_ids),
]

#: Hashing and coding stages can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again as the next one's docs."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k > 1:
            ws.drop(f"stage{k - 2}")
    return docs
