"""A corpus pipeline: five stages over `documents`, each on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxspark.functions.session import shared_folder
from ctxspark.llm import bpe, decontam, langid, simhash, suffix_dedup
from ctxspark.llm.queries import RANKS
from ctxspark.llm.util import read, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is less probable than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; the fit takes no labels of the quarter of ids that is held out.

    Null, empty and letterless texts are rejected; null ids and repeated rows stay as they are; long texts are judged
    whole; an empty table, or one without labels, leaves no rows.
    """
    pieces = langid.piece_list(public_tokenizers.path(RANKS))
    langs, prob = langid.fit(docs.where(~langid.held_out()).select("lang", "text"), pieces)
    judged = langid.predict(docs.select(COLUMNS), pieces, langs, prob, keep=True)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest id, nulls last; a row that is repeated stays once.

    Texts are grouped by SimHash fingerprints through BK-trees, and by bands of minimal hashes where near copies are more
    bits apart; an exact check of the shingles decides.

    All null and empty texts are one group; rows without an id are told apart by their texts; long texts are compared
    whole; an empty table gives no rows.
    """
    keep = saved(simhash.representatives(docs).withColumnRenamed("doc_id", "id"))
    keyed = docs.select(*COLUMNS, simhash.text_key().alias("key"))
    kept = lambda few: keyed.join(few, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left_semi")
    repeated = keep.where("n > 1")
    if repeated.isEmpty():
        return kept(keep).select(COLUMNS)
    return kept(keep.where("n = 1")).union(kept(repeated).dropDuplicates(["doc_id", "key"])).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages from the texts; a character cut in two goes whole. Documents of which nothing is left go.

    Null and empty texts stay as they are; repeated rows (equal id and text) are one document and all stay; rows without
    an id come before all others; an empty table gives no rows.
    """
    rows = suffix_dedup.dedup(docs.withColumn("no_text", F.col("text").isNull()), decoded=True, carry=("lang", "source", "no_text"))
    text = F.when(~F.col("more.no_text"), F.col("kept"))
    return rows.where("size(spans) = 0 or kept <> ''").select("doc_id", text.alias("text"), "more.lang", "more.source", F.length(text).cast("long").alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark. Null and empty texts hold none; rows without an id, or of
    one id, are judged apart; an empty benchmark drops nothing."""
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))  # rows without an id, or of one id, are judged apart
    bad = decontam.contamination(keyed, read(spark, sf_dir, "benchmark"), id_col="row").where("size(hits) > 0").select("row").distinct()
    return keyed.join(bad, "row", "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, and whether they decode to its text. Null and empty texts have no
    tokens; null ids and repeated rows stay; long texts are encoded whole; an empty table gives no rows."""
    ids = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("BPE encoding", encode)]
#: No stage but decontamination has a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared checkpoint folder and read again. Only the
    last stage's rows stay there. An empty table gives no rows."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
        if n:  # the stage before has been read for the last time
            remove(spark, f"{base}/{n - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
