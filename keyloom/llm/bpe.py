"""Byte-level BPE by corpus-level merge replay, and its inverse.

Texts are split by the pre-token pattern.  The distinct pre-tokens of a block of
documents form one small corpus: an inverted index maps each mergeable token pair to
the word positions where it stands, ranks are replayed in ascending order over that
index, and every merge touches only its two neighbours.  A long word costs
n log n, not n squared.  Results are kept per worker in a bounded memo, so later
blocks replay only words not met before.

Blocks, not the whole table, are the corpus of one replay: joining a table-wide
vocabulary back to every occurrence would shuffle more bytes than the text has.

Edge cases: null text encodes as empty text, which has no tokens and decodes to empty
bytes; a text of any length is encoded whole; ids without a token raise on decoding;
repeated rows are encoded alike; added columns get names that ``docs`` does not have; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .frames import free_name, held, map_arrow, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A replay holds about 120 bytes for each byte of the words that its block is the first to have.
BLOCK_BYTES = 64 << 10
MEMO_WORDS = 100_000
MEMO_WORD_CHARS = 64
#: Counting keeps one number a chunk or word, so its memos may hold more.
MEMO_CHUNKS = 600_000
_CHUNK = regex.compile(r"\s*\S+|\s+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Replay:
    """Merge replay over sets of distinct words, by one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)])
        #: Each pair of tokens that merges, as ``left << 20 | right``, and the merged token's rank.
        self.merges: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.merges[left << 20 | right] = rank
        #: The same for pairs of single bytes.
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]).reshape(256, 256)
        self.words_seen: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.exact: dict[str, bytes] = {}

    def words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of each distinct word, replayed together."""
        words = list(words)
        if not words:
            return {}
        flat, last = self._replayed(words)
        ends = np.cumsum(flat >= 0)[last] * 4
        kept = flat[flat >= 0].tobytes()
        out, a = {}, 0
        for w, b in zip(words, ends.tolist()):
            out[w] = kept[a:b]
            a = b
        return out

    def sizes(self, words: list[str]) -> np.ndarray:
        """How many tokens each distinct word has."""
        flat, last = self._replayed(words)
        return np.diff(np.cumsum(flat >= 0)[last], prepend=0)

    def _replayed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids at the byte places of all words (-1 where a token goes on), and each word's last place."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        whole = np.fromiter(map(self.ranks.get, data, repeat(-1)), np.int64, len(data))
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        first = np.cumsum(sizes) - sizes
        raw = np.frombuffer(b"".join(data), np.uint8)
        start = self.byte_ids[raw]
        n = len(start)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:] - 1] = after[-1] = -1  # links never cross a word
        before[first] = -1
        done = np.flatnonzero(whole >= 0)  # a word that is a token needs no merge
        inside = np.repeat(whole >= 0, sizes)
        start[inside] = -1
        start[first[done]] = whole[done]
        after[inside] = -1
        at = np.flatnonzero(after >= 0)
        found = self.byte_pairs[raw[at], raw[at + 1]]
        at, found = at[found >= 0], found[found >= 0]
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(np.diff(found, prepend=-1))
        index: dict[int, list[int]] = {r: x.tolist() for r, x in zip(found[cuts].tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        queue = list(index)  # ascending, so a heap
        ids, after, before = start.tolist(), after.tolist(), before.tolist()
        merge, push, own_of = self.merges.get, heapq.heappush, index.get
        while queue:
            rank = heapq.heappop(queue)
            at = index.pop(rank)
            at.sort()
            for k, i in enumerate(at):
                left = ids[i]
                j = after[i]
                if left < 0 or j < 0 or merge(left << 20 | ids[j]) != rank:
                    continue
                ids[i], ids[j] = rank, -1
                after[i] = nxt = after[j]
                prev = before[i]
                low = rank
                if nxt >= 0:
                    before[nxt] = i
                    r = merge(rank << 20 | ids[nxt])
                    if r is not None:
                        if (own := own_of(r)) is None:
                            index[r] = [i]
                            push(queue, r)
                        else:
                            own.append(i)
                        if r < low:
                            low = r
                if prev >= 0:
                    r = merge(ids[prev] << 20 | rank)
                    if r is not None:
                        if (own := own_of(r)) is None:
                            index[r] = [prev]
                            push(queue, r)
                        else:
                            own.append(prev)
                        if r < low:
                            low = r
                if low < rank:  # an earlier rank came up: it goes first
                    if rest := at[k + 1 :]:
                        if rank in index:
                            index[rank] += rest
                        else:
                            index[rank] = rest
                            push(queue, rank)
                    break
        return np.array(ids, np.int32), first + sizes - 1

    def _split(self, chunks: dict[str, str], seen: dict[str, bytes]) -> None:
        """Add the ids of new chunks (key: text to split) to ``seen``."""
        split = {key: self.pattern.findall(chunk) for key, chunk in chunks.items()}
        known = self.words_seen
        fresh = {w for words in split.values() for w in words if w not in known}
        if fresh:
            known.update(self.words(fresh))
        for key, words in split.items():
            seen[key] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        _forget(known, fresh)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of one block."""
        spaced, exact = self.spaced, self.exact
        parts, new_spaced, new_exact = _chunks(texts, spaced, exact)
        self._split(new_spaced, spaced)
        self._split(new_exact, exact)
        out = []
        for head, rest, found, missing in parts:
            for k in missing:
                found[k] = spaced[rest[k]]
            out.append(np.frombuffer(b"".join([*map(exact.__getitem__, head), *found]), np.int32))
        _forget(spaced, new_spaced)
        _forget(exact, new_exact)
        return out


def _chunks(texts: list[str], spaced: dict, exact: dict) -> tuple[list, dict[str, str], dict[str, str]]:
    """Each text in chunks (head, rest, what ``spaced`` has of rest, places it lacks), and the chunks in neither memo.

    No pre-token holds white space after other characters, so a text can be cut
    wherever white space begins, and equal chunks are split and looked up once.
    Where no space has other white space beside it, that is a plain split at spaces.
    """
    parts, new_spaced, new_exact = [], {}, {}
    for t in texts:
        first, *rest = t.split(" ")
        head = [first] if first else []
        found = list(map(spaced.get, rest))
        missing = [k for k, x in enumerate(found) if x is None] if None in found else []
        new = [rest[k] for k in missing]
        if (new and any(not c or c[0].isspace() or c[-1].isspace() for c in new)) or (rest and first[-1:].isspace()):
            head, rest, found, missing = _CHUNK.findall(t), [], [], []
        else:
            new_spaced.update((c, " " + c) for c in new)
        new_exact.update((c, c) for c in head if c not in exact)
        parts.append((head, rest, found, missing))
    return parts, new_spaced, new_exact


class Counts:
    """Token counts by one vocabulary; its memos hold one number a chunk or word, and no ids."""

    def __init__(self, replay: Replay):
        self.replay = replay
        self.words: dict[str, int] = {}
        self.spaced: dict[str, int] = {}
        self.exact: dict[str, int] = {}

    def _add(self, chunks: dict[str, str], seen: dict[str, int]) -> None:
        """Add the counts of new chunks to ``seen``."""
        known = self.words
        split = {key: self.replay.pattern.findall(chunk) for key, chunk in chunks.items()}
        fresh = list({w for words in split.values() for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.replay.sizes(fresh).tolist()))
        for key, words in split.items():
            seen[key] = known[words[0]] if len(words) == 1 else sum([known[w] for w in words])
        _forget(known, fresh, MEMO_CHUNKS)

    def count(self, texts: list[str]) -> list[int]:
        spaced, exact = self.spaced, self.exact
        parts, new_spaced, new_exact = _chunks(texts, spaced, exact)
        self._add(new_spaced, spaced)
        self._add(new_exact, exact)
        out = []
        for head, rest, found, missing in parts:
            for k in missing:
                found[k] = spaced[rest[k]]
            out.append(sum(found) + sum(map(exact.__getitem__, head)))
        _forget(spaced, new_spaced, MEMO_CHUNKS)
        _forget(exact, new_exact, MEMO_CHUNKS)
        return out


def _forget(memo: dict, new: Iterable[str], most: int | None = None) -> None:
    """Keep a memo within its bounds: the newest entries go, and long ones.  Nothing but speed depends on it."""
    full = len(memo) > (most or MEMO_WORDS)
    for w in new:
        if full or len(w) > MEMO_WORD_CHARS:
            del memo[w]


class Bytes:
    """The inverse of a rank table: ids to the bytes that they stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.length = np.full(max(ranks.values()) + 1, -1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        size = np.maximum(self.length, 0)
        self.start = np.cumsum(size) - size

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length) or self.length[ids].min() < 0):
            raise ValueError("an id has no token")
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)].tobytes()


def _tool(shared) -> tuple[Replay, Bytes]:
    """One replay (with its memo) and one decoder for each rank table and worker process."""
    ranks, pattern = shared.value
    return held(("replay", id(ranks)), lambda: (Replay(ranks, pattern), Bytes(ranks)))


def _shared(df: DataFrame, path: str | None, pattern: str):
    """The rank file, read on the driver and broadcast; a vocabulary's size is fixed."""
    return df.sparkSession.sparkContext.broadcast((load_ranks(path or public_tokenizers.path(VOCABULARY)), pattern))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``docs`` with a column of token ids and, if named, one of the bytes that these decode to.

    Names that ``docs`` has already are lengthened.  ``path`` is the rank file on the driver.
    """
    shared = _shared(docs, path, pattern)
    out = free_name(docs, ids)
    back = free_name(docs, decoded) if decoded else None

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = W.column(batch, text)
        replay, table = _tool(shared)
        gc.disable()  # nothing here makes cycles, and the memo is large
        for a, b in W.slices(texts, BLOCK_BYTES):
            found = replay.encode(texts.slice(a, b - a).to_pylist())
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            cols = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]
            if back:
                cols.append(pa.array([table.decode(x) for x in found], pa.binary()))
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*batch.schema.names, out, *([back] if back else [])])

    return map_arrow(docs, rows, f"{_fields(docs)}, `{out}` array<int>" + (f", `{back}` binary" if back else ""), holds=True)


def count(docs: DataFrame, vocabularies: Sequence[str], texts: dict[str, tuple[str, int]], pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``docs`` with token counts of text columns (null: 0) in place of the columns.

    ``vocabularies`` are rank files on the driver; ``texts`` gives, for each text column, the
    name of its count and which of the vocabularies counts it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(([load_ranks(p) for p in vocabularies], pattern))
    kept = [c for c in docs.columns if c not in texts]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranks, pattern = shared.value
        tools = held(("counts", id(ranks)), lambda: [Counts(Replay(r, pattern)) for r in ranks])
        gc.disable()  # nothing here makes cycles, and the memo is large
        cols = []
        for name, (_, vocabulary) in texts.items():
            own, counts = W.column(batch, name), tools[vocabulary]
            found = [x for a, b in W.slices(own, BLOCK_BYTES) for x in counts.count(own.slice(a, b - a).to_pylist())]
            cols.append(pa.array(found, pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *cols], names=[*kept, *[out for out, _ in texts.values()]])

    return map_arrow(docs, rows, ", ".join([_fields(docs.select(*kept)), *[f"`{out}` bigint" for out, _ in texts.values()]]), holds=True)


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` with a binary column of the bytes that its ids stand for (null ids: null)."""
    shared = _shared(encoded, path, public_tokenizers.PATTERN)
    name = free_name(encoded, out)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = _tool(shared)[1]
        col = batch.column(batch.schema.get_field_index(ids))
        made = [table.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in col]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, name])

    return map_arrow(encoded, rows, f"{_fields(encoded)}, `{name}` binary", holds=True)


def digest(docs: DataFrame) -> DataFrame:
    """The encoded and decoded documents as counts and hashes."""
    return encode(docs.select("doc_id", "text"), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
