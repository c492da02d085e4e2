"""What the operators hold at once."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from keyloom.llm import bpe, frames
from keyloom.llm import words as W


def test_encoding_words_not_met_before_holds_little():
    """The first block of a worker has only new words; its replay must not hold all of a batch at once."""
    replay = bpe.Replay(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    letters = np.random.default_rng(1).integers(97, 123, (60_000, 9), np.uint8)
    texts = pa.array([" ".join(w.tobytes().decode() for w in letters[k : k + 1000]) for k in range(0, len(letters), 1000)])
    tracemalloc.start()
    sizes = [len(x) for a, b in W.slices(texts, bpe.BLOCK_BYTES) for x in replay.encode(texts.slice(a, b - a).to_pylist())]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == len(texts) and min(sizes) > 1000
    assert most < 90e6


def test_encoding_in_blocks_holds_a_block_of_new_words():
    replay = bpe.Replay(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    letters = np.random.default_rng(2).integers(97, 123, (30_000, 9), np.uint8)
    texts = pa.array([" ".join(w.tobytes().decode() for w in letters[k : k + 100]) for k in range(0, len(letters), 100)])
    tracemalloc.start()
    sizes = [len(x) for a, b in W.slices(texts, bpe.BLOCK_BYTES) for x in replay.encode(texts.slice(a, b - a).to_pylist())]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == len(texts)
    assert most < 25e6


def test_batches_of_long_texts_are_small(spark):
    """A batch is bounded by its bytes, too; whatever its size, every row comes through."""

    def rows(batch):
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('x', 200000) text")
    found = frames.map_arrow(docs, rows, "n long, size long").collect()
    assert sum(r.n for r in found) == 60
    assert max(r.size for r in found) < frames.BATCH_BYTES + 300_000
