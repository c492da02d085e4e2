"""Quality rules with host-level verdicts.

Every document gets exact word, symbol and repetition counts.  Rule failures are
summed by host, each host's failure rate is shrunk towards the corpus by a beta
prior that is fitted to the hosts themselves (method of moments), and hosts whose
shrunk rate lies far above that prior lose all their documents.

Edge cases: null or empty text has no words and fails the word-count rule; a text of
any length is counted whole, by word and line hashes of 64 bits; a null host is a host
of its own; an empty table gives no rows; with a single host, or hosts that agree
exactly, the prior is the strongest allowed one.  Repeated rows count each time they
occur.  Columns besides id, host and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .frames import map_arrow, stored, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host goes when its shrunk rate is OUTLIER standard deviations of the fitted prior above its mean;
#: a rate below LEAST_REJECT never costs a host, one of MOST_REJECT always does.
OUTLIER, LEAST_REJECT, MOST_REJECT = 3.0, 0.2, 0.5
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dup_lines(s: W.Scan) -> np.ndarray:
    breaks = np.flatnonzero(s.raw == 10)
    bounds = np.unique(np.concatenate((s.offsets, breaks + 1)))
    start, end = bounds[:-1], bounds[1:]
    end = end - (s.raw[end - 1] == 10)
    busy = np.searchsorted(s.start, end) > np.searchsorted(s.start, start)
    start, end = start[busy], end[busy]
    doc, h = np.searchsorted(s.offsets, start, "right") - 1, s.span_hash(start, end)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    return np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (h[1:] == h[:-1])], minlength=s.rows)


def _repeat_words(s: W.Scan) -> np.ndarray:
    h, at = W.shingles(s.word_hash(), s.doc, 3)
    key = W.mix(h + s.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(s.start), bool)
    for k in range(3):
        covered[at[order[twice]] + k] = True
    return np.bincount(s.doc[covered], minlength=s.rows)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its id, host and the exact counts, in one narrow pass."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = W.column(batch, "text")
        for a, b in W.slices(texts):
            s = W.scan(texts.slice(a, b - a))
            full = ~W._SPACE[s.raw]
            counts = [s.words_per_doc(), s.per_doc(full & ((s.raw & 0xC0) != 0x80)), s.per_doc(_SYMBOL[s.raw]), _dup_lines(s), _repeat_words(s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c.astype(np.int64)) for c in counts)],
                names=["doc_id", "host", *names],
            )

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    return map_arrow(kept, rows, f"doc_id {kind}, host string, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and verdict.

    The prior's mean and strength come from the hosts' own means and variances; the
    strength is held between two documented bounds, so a host of a few documents is
    judged mostly by the corpus and a large one by itself.  The rate that a host may not
    reach follows the prior: its mean and OUTLIER of its standard deviations.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"),
        F.avg(1 / F.col("n_docs")).alias("inv"),
    )
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - spread * F.col("inv")
    strength = F.when(between > 0, spread / between - 1).otherwise(MOST_PRIOR)
    strength = F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(LEAST_PRIOR), strength))
    prior = prior.select(F.lit(1).alias("one"), F.col("mean"), strength.alias("strength"))
    far = F.col("mean") + OUTLIER * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    limit = F.least(F.lit(MOST_REJECT), F.greatest(F.lit(LEAST_REJECT), far))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return (
        hosts.withColumn("one", F.lit(1))
        .join(F.broadcast(prior), "one")  # the prior is one row
        .select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk < limit).alias("host_kept"))
    )


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts, the document's own verdict and its host's, per document."""
    measured = stored(measure(docs, doc_id, text, host).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(measured).select(F.col("host").alias("of"), "host_rate", "host_kept")
    return (
        measured.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
        .drop("of")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
    )


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(*COLUMNS)


def host_rules_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where hosts differ: a document's host is its source and the number of digits of its length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(":", "source", F.length(F.length("text").cast("string")).cast("string")).alias("host"))
    return apply_rules(docs, host="host").select(*COLUMNS)


_SQL = r"""
WITH words AS (
  SELECT doc_id, {host} AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS c
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS wc,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, coalesce(var_samp(f / n), 0) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, least(1000.0, greatest(2.0, CASE WHEN v - mean * (1 - mean) * inv > 0
        THEN mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1 ELSE 1000.0 END)) AS k FROM p),
k AS (SELECT source, (f + mean * k) / (n + k) < least(0.5, greatest(0.2, mean + 3.0 * sqrt(mean * (1 - mean) / (k + 1)))) AS ok FROM h, q)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ok AS kept
FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source
"""
SQL = _SQL.replace("{host}", "source")
SQL_BY_LENGTH = _SQL.replace("{host}", "concat_ws(':', source, length(length(text)::VARCHAR)::VARCHAR)")
