"""Token-count rollups maintained by deltas.

The store keeps, for each committed batch, additive totals by source, language and
tokenizer version.  An insert adds a document and its tokens, a delete takes them away, a
revision adds the difference of the counts.  A batch is reduced before it is written, so
totals never need the documents again.

A commit is idempotent: a batch is one folder named by its id, written whole and marked
by its ``_SUCCESS`` file; a batch that is marked is not applied again, and one that was
cut off by a lost driver is overwritten.  ``compact`` folds marked batches into one
snapshot that names them.

Edge cases: null source, language or tokenizer is a group of its own; null counts count 0;
groups whose totals return to nothing are left out of the result; a batch without rows,
or of an empty table, commits; repeated rows in a batch count each time; unknown operations
raise; columns of a batch besides its own six are not read.  Counts are longs, so texts of
any length add up.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .frames import shared_folder, stored, table
from .mixing import WORD

#: The tokenizer version that documents come with and the one that some move to: name and rank file.
TOKENIZERS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(deltas: DataFrame) -> DataFrame:
    """(op, source, lang, tokenizer, tokens, old_tokens) as additive (GROUP, n_docs, n_tokens)."""
    new, old = F.coalesce("tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    wrong = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old).otherwise(wrong)
    return deltas.select(*GROUP, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens"))


class Rollup:
    """A rollup store in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _marked(self, kind: str) -> list[str]:
        where = self._file(kind)
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(n for n in names if self._fs.exists(self._file(kind, n, "_SUCCESS")))

    def _compacted(self) -> tuple[str | None, set[str]]:
        last = max(self._marked("snapshots"), default=None)
        if last is None:
            return None, set()
        done = self.spark.read.parquet(f"{self.path}/snapshots/{last}/batches").collect()  # one short row per batch
        return last, {r[0] for r in done}

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before."""
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError("a batch id must be a plain folder name")
        if batch in self._marked("batches") or batch in self._compacted()[1]:
            return False
        sums = signed(deltas).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _parts(self) -> DataFrame:
        last, done = self._compacted()
        paths = [f"{self.path}/batches/{b}" for b in self._marked("batches") if b not in done]
        if last is not None:
            paths.append(f"{self.path}/snapshots/{last}/totals")
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        sums = self._parts().groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold everything committed into a new snapshot; readers use it once it is marked."""
        last, done = self._compacted()
        name = f"{int(last or 0) + 1:012d}"
        names = sorted(done | set(self._marked("batches")))
        self.totals().write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/batches")
        self._fs.create(self._file("snapshots", name, "_SUCCESS"), True).close()


def _maintained(spark: SparkSession, first: DataFrame, later: DataFrame) -> DataFrame:
    """The totals after a batch of inserts and one of changes that is sent twice."""
    store = Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("0", first)
    for _ in range(2):
        store.commit("1", later)
    return store.totals()


def _delta(op: str, tokenizer: str, tokens: str | None, old_tokens: str | None) -> Column:
    value = lambda c: (F.col(c) if c else F.lit(None)).cast("long")
    return F.struct(F.lit(op).alias("op"), F.lit(tokenizer).alias("tokenizer"), value(tokens).alias("tokens"), value(old_tokens).alias("old_tokens"))


def token_deltas(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two batches: every document inserted under the first tokenizer; then one in ten deleted, one
    in ten counted anew with its white space made single spaces, and one in ten moved to the second tokenizer."""
    turn = F.col("doc_id") % 10
    texts = docs.select(
        "doc_id", "source", "lang", "text", F.when(turn == 7, F.regexp_replace("text", r"\s+", " ")).alias("cleaned"), F.when(turn == 9, F.col("text")).alias("moved")
    )
    paths = [public_tokenizers.path(f) for f in TOKENIZERS.values()]
    counted = stored(bpe.count(texts, paths, {"text": ("now", 0), "cleaned": ("later", 0), "moved": ("other", 1)}))
    old, new = TOKENIZERS
    first = counted.select("source", "lang", _delta("insert", old, "now", None).alias("x")).select("source", "lang", "x.*")
    changes = F.when(turn == 3, F.array(_delta("delete", old, None, "now"))).when(turn == 7, F.array(_delta("revise", old, "later", "now")))
    changes = changes.when(turn == 9, F.array(_delta("delete", old, None, "now"), _delta("insert", new, "other", None)))
    return first, counted.where(turn.isin(3, 7, 9)).select("source", "lang", F.inline(changes))


def op9_rollup_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maintained(spark, *token_deltas(table(spark, sf_dir, "documents")))


def rollup_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same store over counts that SQL can repeat: words (revised: runs of letters) and bytes."""
    words, letters = F.regexp_count("text", F.lit(WORD)), F.regexp_count("text", F.lit(r"[A-Za-z]+"))
    of = lambda name, tokens, revised: F.struct(F.lit(name).alias("tokenizer"), tokens.alias("tokens"), revised.alias("revised"))
    size: Column = F.octet_length("text")
    versions = F.array(of("words/1", words, F.when(F.col("doc_id") % 10 == 7, letters)), of("bytes/1", size, size))
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.inline(versions))
    first = counted.select(F.lit("insert").alias("op"), *GROUP, "tokens", F.lit(None).cast("long").alias("old_tokens"))
    gone, new = F.col("doc_id") % 10 == 3, F.col("doc_id") % 10 == 7
    later = counted.where(gone | new).select(F.when(gone, "delete").otherwise("revise").alias("op"), *GROUP, F.col("revised").alias("tokens"), F.col("tokens").alias("old_tokens"))
    return _maintained(spark, first, later)


SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang, t.tokenizer, t.tokens, t.revised FROM (
    SELECT doc_id, source, lang, unnest([
      {'tokenizer': 'words/1', 'tokens': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 'revised': len(regexp_extract_all(text, '[A-Za-z]+'))},
      {'tokenizer': 'bytes/1', 'tokens': octet_length(encode(text)), 'revised': octet_length(encode(text))}]) AS t
    FROM documents))
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs,
       sum(CASE WHEN doc_id % 10 = 7 THEN coalesce(revised, 0) ELSE coalesce(tokens, 0) END)::BIGINT AS n_tokens
FROM c WHERE doc_id % 10 <> 3 GROUP BY ALL
"""
