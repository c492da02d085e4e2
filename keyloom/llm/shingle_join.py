"""N-gram Jaccard self-join and its components, by signature trees.

A document's set holds its distinct five-word shingles; two documents link when
100 * intersection >= 75 * union.  The join is exact:

1. Sets are ordered by one fixed order of shingles - rare before frequent, by a fixed-size
   count table, then by hash.  Of two linked sets, a shingle among the first seventh of the
   smaller one stands among the first quarter of the larger one (prefix filter), so only
   documents that share such a shingle are ever compared.  Equal sets are one node.
2. Each shingle's group names its most central member.  Nodes are gathered once, with
   their sets, around the member that they share most shingles with, in blocks of bounded
   size.  A block is joined by a signature tree: leaves hold token bitmaps, inner nodes
   their OR and size range, and a dual traversal drops node pairs whose greatest possible
   overlap is too small or that are already one component.
3. Shingles whose group still spans components are open.  First the most central member of
   each component meets the most central one of the group.  What stays open is joined by
   the same trees, by shingle and size band: large groups are dealt in chunks, every two
   chunks meet in one task, and no pair is ever a row.  Trees over bitmaps alone first tell
   who may link with whom; only members of such candidate groups bring their sets, once for
   all their shingles, and are joined exactly.

Hashes have 64 bits, for shingles and for whole sets.

Edge cases: null text, and text without words, is the empty set and links with nothing;
fewer than five words are one shingle; a text of any length is one set, scanned whole;
repeated rows share a component, and rows that repeat an id with other texts are separate
documents; a null id is never smallest while another id is there; columns besides id and
text, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .components import absorb, components
from .frames import map_arrow, stored, table, tidy, trim

WORDS, PERCENT = 5, 75
SKETCH_BITS, SLABS = 20, 64
BLOCK_SHINGLES = 1_000_000
CHUNK_MEMBERS = 1500
LEAF, FAN = 16, 4
TRIM_NODES = 200
BATCH_PAIRS = 1 << 14
#: Tables of so many ids at most are broadcast (16 bytes each); larger ones are joined by a shuffle.
MOST_BROADCAST = 4_000_000


# ---- sets ------------------------------------------------------------------------------


def _hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """All shingle hashes of some texts, with each text's first position."""
    s = W.scan(texts, lower=True)
    words = s.word_hash()
    found, at = W.shingles(words, s.doc, size)
    doc = s.doc[at]
    count = s.words_per_doc()
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(s.doc, few)
        short = W.mix(count[few].astype(np.uint64))
        for k in range(size - 1):
            have = count[few] > k
            short[have] = W.mix(short[have] * np.uint64(0x9E3779B97F4A7C15) + words[first[have] + k])
        order = np.argsort(np.concatenate((doc, few)), kind="stable")
        found, doc = np.concatenate((found, short))[order], np.concatenate((doc, few))[order]
    return found, np.searchsorted(doc, np.arange(s.rows + 1)), s.rows


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for a, b in W.slices(texts):
        found, at, rows = _hashes(texts.slice(a, b - a), size)
        for k in range(rows):
            yield np.unique(found[at[k] : at[k + 1]])


def _node(own: np.ndarray) -> int:
    return int(W.mix(np.array([W.mix(own).sum(dtype=np.uint64) + np.uint64(len(own))]))[0].astype(np.int64))


def _signature(own: np.ndarray, more: int = 1) -> bytes:
    """A bitmap of twice (times ``more``) as many bits as shingles, rounded up to a power of two."""
    bits = max(64, 1 << (2 * more * len(own) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(own >> np.uint64(3)) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _may_link(na: int, nb: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if the sizes or the signatures rule a link out."""
    need = -(-percent * (na + nb) // (100 + percent))
    if min(na, nb) < need:
        return False
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    la, lb = 8 * len(a), 8 * len(b)
    while la > lb:
        la //= 2
        x = (x >> la) | (x & ((1 << la) - 1))
    while lb > la:
        lb //= 2
        y = (y >> lb) | (y & ((1 << lb) - 1))
    return na - (x & ~y).bit_count() >= need and nb - (y & ~x).bit_count() >= need


def frequent_cells(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles in a fixed table of cells.

    The table only sets the order of shingles, so it affects speed, not results: a shingle
    that many documents share stands out from the others in its cell and goes last.  Tasks
    send it in SLABS parts of packed counts, which are summed apart.
    """
    cells = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            texts = W.column(batch, "text")
            for a, b in W.slices(texts):
                found, _, _ = _hashes(texts.slice(a, b - a), size)
                total += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        if total.any():
            packed = [x.tobytes() for x in np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32).reshape(SLABS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array(packed, pa.binary())], names=["slab", "counts"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells // SLABS, np.int64)
        for part in parts:
            for x in part.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slab", "counts"])

    sums = docs.select("text").mapInArrow(run, "slab int, counts binary").groupBy("slab").applyInArrow(add, "slab int, counts binary").toArrow()
    counts = np.zeros(cells, np.int64)
    for slab, x in zip(sums.column("slab").to_pylist(), sums.column("counts").to_pylist()):
        counts.reshape(SLABS, -1)[slab] = np.frombuffer(x, np.int64)
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def prepare(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, node, n, tokens, sig) of (doc_id, text), and what columns follow these; node is null for the empty set."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, size))
    more = docs.columns[2:]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        texts = W.column(batch, "text")
        nodes, sizes, tokens, sigs = [], [], [], []
        for own in shingle_sets(texts, size):
            n = len(own)
            sizes.append(n)
            if not n:
                nodes.append(None)
                tokens.append(None)
                sigs.append(None)
                continue
            nodes.append(_node(own))
            sigs.append(_signature(own))
            keep = _prefix(n, percent)
            count = cells[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            tokens.append(own[np.argsort(count, kind="stable")[:keep]].view(np.int64))
        lengths = np.zeros(len(nodes) + 1, np.int32)
        np.cumsum([0 if t is None else len(t) for t in tokens], out=lengths[1:])
        flat = np.concatenate([t for t in tokens if t is not None] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.array(sigs, pa.binary()), *batch.columns[2:]],
            names=["doc_id", "node", "n", "tokens", "sig", *more],
        )

    own = "".join(f", `{c}` {t}" for c, t in docs.dtypes[2:])
    return map_arrow(docs, rows, f"doc_id {dict(docs.dtypes)['doc_id']}, node long, n long, tokens array<long>, sig binary{own}")


# ---- signature trees -------------------------------------------------------------------


def _prefix(n: int, percent: int) -> int:
    """How many first shingles of n a set must share with any linked one."""
    return n - -(-percent * n // 100) + 1


def _reach(n: Column, place: Column, percent: int) -> Column:
    """The greatest size of a linked set whose first common shingle is this one, ``place`` shingles from the first.

    What stands from there on must suffice for the overlap: need(n, m) <= n - place.
    """
    return (F.floor((100 + percent) * (n - place) / percent) - n).cast("int")


def _bitmaps(sigs: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, folded to the width of the shortest."""
    words = min(map(len, sigs)) // 8
    out = np.empty((len(sigs), words), np.uint64)
    for k, x in enumerate(sigs):
        out[k] = np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0)
    return out


class SignatureTree:
    """Sets sorted by size, in leaves of LEAF under nodes of FAN children.

    A node holds the OR of its sets' bitmaps, its size range and its greatest slack, the
    number of shingles that share a bit with another one of their set.  The overlap of any
    two sets of two nodes is at most the bits that both nodes have plus the lesser slack.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, roots: np.ndarray, percent: int):
        self.percent, self.sizes, self.bits, self.roots = percent, sizes, bits, roots
        own = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels: list[tuple[np.ndarray, ...]] = []
        level = (bits, sizes, sizes, sizes - own)
        for width in (LEAF, *[FAN] * 64):
            at = np.arange(0, len(level[0]), width)
            last = np.minimum(at + width, len(level[0])) - 1
            level = (np.bitwise_or.reduceat(level[0], at, axis=0), level[1][at], level[2][last], np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            if len(at) <= FAN:
                break
        self.compared = 0

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def _single(self, x: np.ndarray, y: np.ndarray, sets: int) -> np.ndarray:
        """Whether all sets of two nodes of so many sets are one component."""
        at = np.arange(0, len(self.roots), sets)
        low, high = np.minimum.reduceat(self.roots, at), np.maximum.reduceat(self.roots, at)
        return (low[x] == high[x]) & (low[x] == low[y]) & (low[y] == high[y])

    def _leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (x <= y) that may hold a link between two components."""
        x, y = np.triu_indices(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            bits, least, most, slack = self.levels[k]
            keep = (100 * most[x] >= self.percent * least[y]) & ~self._single(x, y, LEAF * FAN**k)
            x, y = x[keep], y[keep]
            keep = np.ones(len(x), bool)
            for a in range(0, len(x), BATCH_PAIRS):
                u, v = x[a : a + BATCH_PAIRS], y[a : a + BATCH_PAIRS]
                both = np.bitwise_count(bits[u] & bits[v]).sum(1, dtype=np.int64) + np.minimum(slack[u], slack[v])
                keep[a : a + BATCH_PAIRS] = (u == v) | (both >= self.need(least[u], least[v]))
            x, y = x[keep], y[keep]
            if k:
                u, v = np.divmod(np.arange(FAN * FAN), FAN)
                x, y = (FAN * x[:, None] + u).ravel(), (FAN * y[:, None] + v).ravel()
                keep = (x <= y) & (y < len(self.levels[k - 1][1]))
                x, y = x[keep], y[keep]
        return x, y

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of sets that may link, the smaller first, while ``roots`` keeps them apart."""
        x, y = self._leaves()
        u, v = np.divmod(np.arange(LEAF * LEAF), LEAF)
        step = BATCH_PAIRS // (LEAF * LEAF)
        for a in range(0, len(x), step):
            i, j = (LEAF * x[a : a + step, None] + u).ravel(), (LEAF * y[a : a + step, None] + v).ravel()
            keep = (i < j) & (j < len(self.sizes))
            i, j = i[keep], j[keep]
            keep = (self.roots[i] != self.roots[j]) & (100 * self.sizes[i] >= self.percent * self.sizes[j])
            i, j = i[keep], j[keep]
            if len(i):
                p, q, need = self.bits[i], self.bits[j], self.need(self.sizes[i], self.sizes[j])
                missing = lambda p, q: np.bitwise_count(p & ~q).sum(1, dtype=np.int64)
                keep = (self.sizes[i] - missing(p, q) >= need) & (self.sizes[j] - missing(q, p) >= need)
                yield i[keep], j[keep]


def links_within(sets: list[np.ndarray], percent: int, center: int | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """For each sorted set the place of its component's first set, and how many pairs were compared.

    ``center`` meets every set before the tree is walked.  Sets with equal ``known`` are one
    component already.
    """
    order = np.argsort([len(x) for x in sets], kind="stable")
    own = [sets[k] for k in order]
    sizes = np.array([len(x) for x in own], np.int64)
    roots = np.arange(len(own))
    if known is not None:
        _, first, of = np.unique(known[order], return_index=True, return_inverse=True)
        roots = first[of]
    compared = 0

    def meet(i: int, j: int) -> None:
        nonlocal compared
        a, b = roots[i], roots[j]
        if a != b:
            compared += 1
            x, y = (own[i], own[j]) if len(own[i]) <= len(own[j]) else (own[j], own[i])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                roots[roots == max(a, b)] = min(a, b)

    if center is not None:
        c = int(np.flatnonzero(order == center)[0])
        for k in np.flatnonzero((100 * np.minimum(sizes, sizes[c]) >= percent * np.maximum(sizes, sizes[c]))):
            meet(c, int(k))
    if len(own) > 1 and (roots != roots[0]).any():
        for i, j in SignatureTree(sizes, _bitmaps([_signature(x, 2) for x in own]), roots, percent).pairs():
            for a, b in zip(i.tolist(), j.tolist()):
                meet(a, b)
    first = np.full(len(own), len(own))
    np.minimum.at(first, roots, order)
    out = np.empty(len(own), np.int64)
    out[order] = first[roots]
    return out, compared


# ---- the join --------------------------------------------------------------------------


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where ``rows``, which was counted, is within the bound."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _sets_of(docs: DataFrame, wanted: DataFrame, rows: int, size: int) -> DataFrame:
    """(node, own) of the documents that stand for ``wanted`` (node, rep)."""
    reps = wanted.select(F.col("rep")).distinct()
    picked = docs.join(sized(reps, rows), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = [x for x in shingle_sets(W.column(batch, "text"), size) if len(x)]
        yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])

    return map_arrow(picked.select("text"), made, "node long, own binary")


def _prune(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that sizes and signatures allow, with any other column but the sizes."""
    pairs = stored(pairs.where(F.least("na", "nb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))))
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sigs = info.select("node", "sig").join(sized(ends, ends.count()), "node", "left_semi")
    side = lambda s: sigs.select(F.col("node").alias(s), F.col("sig").alias(f"sig{s}"))
    kept = [c for c in pairs.columns if c not in ("na", "nb")]

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("na", "nb", "siga", "sigb")]
        yes = pa.array([_may_link(*x, percent) for x in zip(*cols)], pa.bool_())
        yield batch.select(kept).filter(yes)

    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in kept)
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select(*kept, "na", "nb", "siga", "sigb"), rows, schema)


def _edges(groups: list[np.ndarray], nodes: np.ndarray, own: list[bytes], percent: int, center: int | None = None, known: np.ndarray | None = None) -> pa.Table:
    """(a, b): each node of some groups (row numbers) with its component's least node, where that is another one."""
    out_a, out_b = [], []
    for rows in groups:
        at, first = np.unique(nodes[rows], return_index=True)
        if len(at) > 1:
            where = None if center is None else int(np.searchsorted(at, center))
            roots, _ = links_within([np.frombuffer(own[k], np.uint64) for k in rows[first]], percent, where, None if known is None else known[rows[first]])
            moved = at[roots] != at
            out_a.append(at[moved])
            out_b.append(at[roots][moved])
    return _pairs(out_a, out_b)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    if sum(map(len, a)) > TRIM_NODES:
        trim()
    none = [np.zeros(0, np.int64)]
    return pa.table({"a": pa.array(np.concatenate(a or none), pa.int64()), "b": pa.array(np.concatenate(b or none), pa.int64())})


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member of a block (center, salt, node, own) and its component's least member."""

    def join(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        return _edges([np.arange(len(nodes))], nodes, group.column("own").to_pylist(), percent, key[0].as_py())

    return members.groupBy("center", "salt").applyInArrow(join, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("own").alias(f"own{s}"))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yes = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return map_arrow(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "owna", "ownb"), rows, "a long, b long")


# ---- what stays open -------------------------------------------------------------------


def _groups(table: pa.Table, keys: list[str], *then: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each group of equal keys, each group in the order of ``then``."""
    cols = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort((*then[::-1], *cols[::-1]))
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return np.split(order, np.flatnonzero(new))


def _packed(df: DataFrame, keys: list[str], load: Column, most: int) -> DataFrame:
    """``df`` with a column ``pack`` of whole groups by ``keys``, about ``most`` of ``load`` together."""
    packs = df.agg(F.ceil(F.sum(load) / most).cast("int")).first()[0] or 1
    return df.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(packs)).cast("int"))


def _dealt(members: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` in meetings of chunks (one, two), each in its own ``chunk``; ``groups`` has the (m, total) of each key."""
    parts = F.greatest(F.ceil(F.col("m") / CHUNK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = members.join(groups.select(*keys, parts.alias("parts")), keys).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return placed.select(*members.columns, "chunk", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"))


KEYS = ["token", "band", "one", "two"]


def _meetings(left: DataFrame, percent: int) -> DataFrame:
    """The open postings (token, node, reach, root, n) by KEYS: token, size band and two chunks.

    Linked sets are in the same band of sizes or in adjacent ones, so a set stands in its own
    band and, where it may be the smaller one, in the next.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent * (1 + 1e-9)))).cast("int")
    bands = F.when(F.col("reach") >= F.col("n"), F.array(band, band + 1)).otherwise(F.array(band))
    placed = left.select("token", F.explode(bands).alias("band"), "node", "reach", "root", "n")
    least = F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).alias("least")
    of = placed.groupBy("token", "band").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), least, F.max("reach").alias("most"), F.sum("reach").alias("reaches"),
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("w"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 31))).alias("v"), F.sum("n").alias("total"),
    ).where("x <> y and least <= most")
    # Of shingles with the same members, the first in the fixed order stands first in all of them: it reaches furthest.
    of = of.groupBy("band", "m", "w", "v", "total").agg(F.max(F.struct("reaches", "token"))["token"].alias("token"))
    return _dealt(placed, of, ["token", "band"])


def _candidates(meetings: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join, within each meeting, the sets that reaches and bitmaps allow to link."""

    def walk(group: pa.Table) -> pa.Table:
        n, node = group.column("n").to_numpy(), group.column("node").to_numpy()
        root, reach, chunk, one, two = (group.column(c).to_numpy() for c in ("root", "reach", "chunk", "one", "two"))
        sigs = group.column("sig").to_pylist()
        out_a, out_b = [], []
        for rows in _groups(group, KEYS, n, node):
            if len(rows) > 1:
                labels = np.arange(len(rows))
                _, known = np.unique(root[rows], return_inverse=True)
                own = chunk[rows] if one[rows[0]] != two[rows[0]] else labels
                for i, j in SignatureTree(n[rows], _bitmaps([sigs[k] for k in rows]), known, percent).pairs():
                    keep = (n[rows[j]] <= reach[rows[i]]) & (n[rows[i]] <= reach[rows[j]]) & (own[i] != own[j])
                    i, j = i[keep], j[keep]
                    while len(keep := labels[i] != labels[j]):
                        i, j = i[keep], j[keep]
                        if not len(i):
                            break
                        low, high = sorted((labels[i[0]], labels[j[0]]))
                        labels[labels == high] = low
                moved = np.flatnonzero(labels != np.arange(len(rows)))
                out_a.append(node[rows[moved]])
                out_b.append(node[rows[labels[moved]]])
        return _pairs(out_a, out_b)

    packed = _packed(meetings, KEYS, F.lit(1), CHUNK_MEMBERS).join(info.select("node", "sig"), "node")
    return packed.groupBy("pack").applyInArrow(walk, "a long, b long")


def _candidate_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the exact components within each candidate group (node, group, root, n)."""

    def join(group: pa.Table) -> pa.Table:
        of = _groups(group, ["group", "one", "two"])
        return _edges(of, group.column("node").to_numpy(), group.column("own").to_pylist(), percent, known=group.column("root").to_numpy())

    loads = groups.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    dealt = stored(_dealt(groups, loads, ["group"]))
    return _packed(dealt, ["group", "one", "two"], F.col("n"), BLOCK_SHINGLES).join(sets, "node").groupBy("pack").applyInArrow(join, "a long, b long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    return rooted(docs, doc_id, text, size, percent).drop("root", "text_hash")


def rooted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The same with ``text_hash``, and ``root``, which tells components apart where ids do not (null: the empty set)."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("text_hash"))
    every = stored(prepare(docs, size, percent))
    nodes = every.where("n > 0").groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n"))
    # The smaller of two linked sets reaches its own size; the reach of those that do not is kept below 0.
    reach = _reach(F.col("n"), F.col("p"), percent)
    postings = nodes.select("node", "n", F.posexplode("tokens").alias("p", "token")).select("token", "node", F.when(reach >= F.col("n"), reach).otherwise(-reach).alias("reach")).repartition("token")
    groups = postings.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("reach").alias("most")).where("low <> high and most > 0").select("token")
    shared = stored(postings.join(groups, "token"))
    # The more of its prefix a node shares, the more central it is: an original shares more than its edits.
    centrality = shared.groupBy("node").agg(F.count(F.lit(1)).alias("hits"))
    about = every.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("rep"))
    info = stored(about.join(centrality, "node").withColumn("central", F.col("hits") / (F.floor(F.col("n") / 4) + 1)))
    # Larger ones must reach the least of these.
    with_sizes = shared.withColumn("reach", F.abs("reach")).join(info.select("node", "n", "central"), "node")
    least = with_sizes.where("reach >= n").groupBy("token").agg(F.min("n").alias("least"))
    shared = stored(with_sizes.join(least, "token").where("reach >= least").drop("least"))
    del with_sizes, least, nodes, postings, groups, centrality, about
    tidy(docs.sparkSession)
    centers = shared.groupBy("token").agg(F.max(F.struct("central", "node", "n")).alias("x")).select("token", F.col("x.node").alias("b"), F.col("x.n").alias("nb"))
    near = shared.withColumnsRenamed({"node": "a", "n": "na"}).join(centers, "token").where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("votes"))
    pick = _prune(near, info, percent).groupBy("a").agg(F.max(F.struct("votes", "b"))["b"].alias("center"))
    pick = stored(pick.withColumnRenamed("a", "node"))
    # Blocks of bounded size; every block of a large cluster holds the center too.
    sizes = info.select("node", "n", "rep")
    total = pick.join(sizes, "node").groupBy("center").agg(F.sum("n").alias("total"))
    salts = total.select("center", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("salts"))
    plain = pick.join(salts, "center").select("center", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    heads = salts.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("node"))
    placed = stored(plain.union(heads).join(sizes.select("node", "rep"), "node"))
    rows = placed.count()
    members = _sets_of(docs, placed, rows, size).join(sized(placed.select("node", "center", "salt"), rows), "node")
    first = stored(components(_blocks(members, percent)))

    def open_postings(first: DataFrame) -> DataFrame:
        left = shared.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
        still = left.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        return stored(left.join(still, "token", "left_semi"))

    def sets_for(ends: DataFrame) -> DataFrame:
        ends = stored(ends.select("node").distinct().join(sizes.select("node", "rep"), "node"))
        return _sets_of(docs, ends, ends.count(), size).dropDuplicates(["node"])

    # The most central member of each component against the most central one of the shingle's group.
    left = open_postings(first)
    heads = left.groupBy("token", "root").agg(F.max(F.struct("central", "node", "root", "n")).alias("x"))
    top = heads.groupBy("token").agg(F.max("x").alias("y"))
    pairs = heads.select("token", "x").join(top, "token").where("x.root <> y.root")
    pairs = pairs.select(F.least(F.struct("x.node", "x.n"), F.struct("y.node", "y.n")).alias("p"), F.greatest(F.struct("x.node", "x.n"), F.struct("y.node", "y.n")).alias("q"))
    pairs = pairs.distinct().select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
    pairs = stored(_prune(pairs, info, percent))
    if not pairs.isEmpty():
        links = stored(_verify(pairs, sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node"))), percent))
        if not links.isEmpty():
            first = absorb(first, links)
            left = open_postings(first)
    tidy(docs.sparkSession)
    maybe = stored(_candidates(stored(_meetings(left, percent)), info, percent))
    if not maybe.isEmpty():
        groups = stored(components(maybe).withColumnRenamed("root", "group"))
        groups = groups.join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes.select("node", "n"), "node")
        links = stored(_candidate_links(stored(groups), sets_for(groups), percent))
        if not links.isEmpty():
            first = absorb(first, links)
    whole = every.select("doc_id", "node", "n", "text_hash").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component"))
    return whole.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "root", "text_hash")


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
