"""The training-data pipeline: five stages over ``documents``, each by one operator of ``keyloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents, and removed once the stage after that is written.

All stages read texts of any length whole, carry further columns along whatever their names
(the last one gives its own), and give no rows for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, langid, linededup, mixing, shingle_join
from keyloom.llm.frames import free_name, remove_at_exit, shared_folder, table


def _same_columns(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Only the columns of ``docs``; ``n_chars``, where there is one, follows the text."""
    cols = [F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*cols)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a determined language, mixtures too; null text and text without letters go.

    Repeated rows are judged alike; of tied languages the first by name counts.
    """
    train = docs.where(~F.coalesce(langid.held_out(), F.lit(False)))
    found, (pred, _, _) = langid.identify(docs, langid.fit(train))
    return found.where(F.col(pred) != langid.UNDETERMINED).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, short ones too, that stand earlier in the corpus; a text of which nothing is left goes.

    Null text stays.  Rows that repeat id and text are one document; a null id stands first,
    and documents that share an id or have none are told apart by their texts.
    """
    done, dropped = linededup.deduplicate(docs, min_chars=linededup.LEAST_EDITED, short=True)
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _same_columns(docs, done.where(~((F.col(dropped) > 0) & empty)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies; repeated rows count once.

    A null id is smallest only among null ids, and of documents that share an id the text's
    hash decides.  Texts without words, null too, link with nothing and stay, once each.
    """
    own, hashed, rows = (free_name(docs, x) for x in ("near_id", "near_hash", "near_rows"))
    marked = shingle_join.stored(shingle_join.rooted(docs).select("doc_id", "text_hash", "root").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("x")
    kept = marked.where("root is not null").groupBy("root").agg(first).select("x.doc_id", "x.text_hash", "x.n")
    kept = shingle_join.stored(kept.union(marked.where("root is null").select("doc_id", "text_hash", "n")).toDF(own, hashed, rows))
    kept = shingle_join.sized(kept, kept.count())
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(hashed)))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    once = found.where(F.col(rows) == 1).select(*cols)
    return once.unionByName(found.where(F.col(rows) > 1).select(*cols).dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, shard by shard; a document that is drawn twice stands there twice.

    Null text has no words and a null source is one more source; repeated rows are separate documents.
    """
    return mixing.mix(docs)[0].select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, row by row; null text has none."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("bpe_encode", encode)]

#: SQL cannot express the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)  # the last stage's input is read until then
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
