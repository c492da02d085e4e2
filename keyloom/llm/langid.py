"""Language identification by multilingual mixture inference.

A model holds, for each language, smoothed log-likelihoods of hashed byte trigrams of
lower-cased words, counted over every training document.  A document is read in units
of a few consecutive words.  Expectation-maximisation estimates the shares of a set of
languages from the units' likelihoods; the set starts with the best single language
and grows while the penalised likelihood (BIC) improves.  The prediction is the
language with the largest share, and its score is that share.

Every language whose greatest possible gain exceeds the penalty is tried at each step.

Edge cases: null text and text without a letter are ``und`` with score 0; words
without letters are no evidence; equal shares go to the language that sorts first;
without training documents everything is ``und``.  Training rows with a null label or
null text are skipped, and repeated rows count each time.  A text of any length is read
whole.  Columns that ``docs`` has keep their names, and those added get longer ones; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .frames import free_name, map_arrow, table

CELLS = 1 << 16
UNIT_WORDS = 8
SMOOTHING = 0.1
TEMPER = 0.5
ROUNDS = 12
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Model:
    """``scores[cell, k]`` is the tempered log-likelihood of a trigram in ``langs[k]``."""

    langs: tuple[str, ...]
    scores: np.ndarray


def _evidence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Cells of the bytes of lettered words; each byte's unit start, the units' rows and sizes."""
    s = W.scan(texts)
    n = len(s.raw)
    folded = np.full(n + 2, 32, np.uint32)
    folded[1:-1] = _FOLD[s.raw]
    cells = ((folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    first = np.searchsorted(s.doc, np.arange(s.rows))
    unit = (np.arange(len(s.start)) - first[s.doc]) // UNIT_WORDS
    opens = np.ones(len(s.start), bool)
    opens[1:] = (s.doc[1:] != s.doc[:-1]) | (unit[1:] != unit[:-1])
    letters = np.concatenate(([0], np.cumsum(_LETTER[s.raw])))
    good = letters[s.end] > letters[s.start]
    cover = np.zeros(n + 1, np.int8)
    cover[s.start[good]] += 1
    cover[s.end[good]] -= 1
    inside = np.flatnonzero(np.cumsum(cover[:-1]))
    starts = s.start[opens]
    at = np.searchsorted(inside, starts)
    size = np.diff(np.append(at, len(inside)))
    busy = size > 0
    return cells[inside], at[busy], s.doc[opens][busy], size[busy], s.rows


def fit(train: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Count trigrams by language over all of ``train``; the result's size is languages x cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = W.column(batch, "text"), batch.column(1)
            for a, b in W.slices(texts):
                cells, at, doc, size, rows = _evidence(texts.slice(a, b - a))
                codes = labels.slice(a, b - a).dictionary_encode()
                code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                each = np.repeat(code[doc], size)
                found = np.bincount(each * CELLS + cells, minlength=len(codes.dictionary) * CELLS)
                for k, name in enumerate(codes.dictionary.to_pylist()):
                    part = found[k * CELLS : (k + 1) * CELLS]
                    counts[name] = counts[name] + part if name in counts else part
        for name, total in counts.items():
            hit = np.flatnonzero(total)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit].astype(np.int64))],
                    names=["lang", "cell", "n"],
                )

    kept = train.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = kept.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = tuple(sorted(set(sums.column("lang").to_pylist())))
    counts = np.zeros((CELLS, len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        col = np.array([place[x] for x in sums.column("lang").to_pylist()])
        counts[sums.column("cell").to_numpy(), col] = sums.column("n").to_numpy()
    seen = max(1, int((counts.sum(1) > 0).sum()))
    scores = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * seen))
    return Model(langs, (TEMPER * scores).astype(np.float32))


def _mixture(like: np.ndarray, peak: np.ndarray, starts: np.ndarray, doc: np.ndarray, size: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: shares and log-likelihood under each one's active set."""
    share = active / active.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * share[doc]
        total = part.sum(1, keepdims=True)
        part /= np.maximum(total, 1e-300)
        share = np.add.reduceat(part, starts, axis=0) / size[:, None]
    total = (like * share[doc]).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)) + peak, starts)


def infer(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predictions, scores and shares (rows x languages) of null-free texts."""
    cells, at, doc, _, rows = _evidence(texts)
    k = len(model.langs)
    shares = np.zeros((rows, k))
    if k and len(at):
        table = np.stack([np.add.reduceat(model.scores[:, j][cells], at) for j in range(k)], axis=1).astype(float)
        peak = table.max(1)
        like = np.exp(np.maximum(table - peak[:, None], -600))
        own, starts = np.unique(doc, return_index=True)
        dense = np.searchsorted(own, doc)
        size = np.diff(np.append(starts, len(doc)))
        single = np.add.reduceat(table, starts, axis=0)
        active = np.zeros((len(own), k))
        active[np.arange(len(own)), single.argmax(1)] = 1
        share, best = active.copy(), single.max(1)
        penalty = 0.5 * np.log(np.maximum(size, 2)) + 1
        # A language can raise the likelihood by no more than its units gain over the chosen ones.
        open_ = np.ones(len(own), bool)
        for _ in range(1, k):
            chosen = np.where(active[dense] > 0, table, -np.inf).max(1)
            gain = np.add.reduceat(np.maximum(table - chosen[:, None], 0), starts, axis=0)
            gain[active > 0] = 0
            trials = np.argsort(-gain, axis=1, kind="stable")
            top, top_share, top_set = best.copy(), share.copy(), active.copy()
            for t in range(trials.shape[1]):
                cand = trials[:, t]
                run = np.flatnonzero(open_ & (gain[np.arange(len(own)), cand] > penalty))
                if not len(run):
                    break
                pick = np.zeros(len(own), bool)
                pick[run] = True
                unit = pick[dense]
                sub_doc = np.searchsorted(run, dense[unit])
                sub_starts = np.cumsum(size[run]) - size[run]
                tried = active[run].copy()
                tried[np.arange(len(run)), cand[run]] = 1
                got, ll = _mixture(like[unit], peak[unit], sub_starts, sub_doc, size[run], tried)
                better = ll - penalty[run] > top[run]
                rows_ = run[better]
                top[rows_], top_share[rows_], top_set[rows_] = (ll - penalty[run])[better], got[better], tried[better]
            open_ &= (top_set != active).any(1)
            best, share, active = top, top_share, top_set
            if not open_.any():
                break
        shares[own] = share
    pred = [UNDETERMINED] * rows
    score = shares.max(1) if k else np.zeros(rows)
    for i in np.flatnonzero(score > 0):
        pred[i] = model.langs[int(shares[i].argmax())]
    odd = np.flatnonzero((score > 0) & ~_has_ascii_letter(texts))
    for i in odd:
        if not any(c.isalpha() for c in texts[int(i)].as_py()):
            pred[i], score[i], shares[i] = UNDETERMINED, 0.0, 0.0
    return pred, np.minimum(score, 1.0), shares


def _has_ascii_letter(texts: pa.Array) -> np.ndarray:
    s = W.scan(texts)
    return s.per_doc(_LETTER[s.raw] & (s.raw < 128)) > 0


def identify(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the prediction, its score and all shares; and these columns' names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = []
    for wish in ("lang_pred", "score", "shares"):
        names.append(free_name(docs, wish))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = W.column(batch, text)
        for a, b in W.slices(texts):
            pred, score, shares = infer(shared.value, texts.slice(a, b - a))
            parts = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), parts], names=[*batch.schema.names, *names])

    return map_arrow(docs, rows, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` array<double>"), tuple(names)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    found, (pred, score, _) = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))
