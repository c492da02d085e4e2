"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line of at least MIN_CHARS code points is dropped when an equal line, or one within
edit distance K, stands earlier in the corpus (by id, then place in the text).  Shorter
lines are left alone, or with ``short`` go where an equal one stands earlier; lines without
a word stay.  The remaining lines of a text are joined again.

1. Equal lines fall into classes by 128-bit hash; a class stands where it first occurs.
2. A class is cut into K + 1 segments; a line within distance K holds one of them
   unchanged.  Its substrings at the places that its length allows (the multi-match-aware
   choice) are probed against the index of (length, segment number, segment).
3. Each line is first compared with the earliest line it meets under a key, so one popular
   segment is no quadratic group while its lines are copies of one.
4. Only lines that are left meet the other earlier ones of their keys.  Under a key of many
   lines they meet by a second key: what stands beside the matched segment has few edits
   too, so it is cut again and must share a piece.  Counts of hashed code points, which K
   edits can change by 2 K at most, decide within the join which pairs become rows.
5. Pairs are verified exactly: of a line cut into CHECK_PIECES pieces, K edits leave all but
   K at their place, give or take K; if so, common ends are stripped by bisection, and a
   banded bit-parallel recurrence (one machine word for the whole band) runs over what is left.

Edge cases: null text has no lines and stays null; empty text stays empty; lines and texts
of any length are compared whole; rows that repeat id and text are copies of one document
and are treated alike; rows that repeat an id with another text, and documents without an
id, are separate documents, ordered among themselves by a hash of the text; a null id
stands first; the added count column gets a name that ``docs`` does not have, and other
columns are carried along whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import free_name, stored, table

MIN_CHARS = 40
#: Below this, K edits make one word of another ("Was.", "Es."), so only equal lines are repeats.
LEAST_EDITED = 10
K = 2
#: Tables of so many bytes at most, by their counted rows, are broadcast; larger ones are shuffled.
MOST_BROADCAST = 48 << 20
PLACE_BYTES = 48
#: Under a key with more lines than this, lines that are left meet by a second key.
PLAIN_KEY = 50
#: Pairs are looked at in so many pieces before their distance is.
CHECK_PIECES = 8


# ---- edit distance ---------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _char(code: Column, i: Column) -> Column:
    """Code point i (from 1) of UTF-32 text."""
    return F.substring(code, 4 * i - 3, F.lit(4))


def _common(a: Column, b: Column, most: Column, end: bool) -> Column:
    """Length of the common prefix (or suffix) of two UTF-32 texts, ``most`` at most, by bisection."""
    la, lb = F.octet_length(a), F.octet_length(b)

    def same(n: Column) -> Column:
        if end:
            return F.substring(a, la - 4 * n + 1, 4 * n) == F.substring(b, lb - 4 * n + 1, 4 * n)
        return F.substring(a, F.lit(1), 4 * n) == F.substring(b, F.lit(1), 4 * n)

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).otherwise(
            _let(mid, lambda m: F.when(same(m), F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi"))))
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(most + 1)).cast("int") + 1)
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.alias("hi")), step, lambda s: s["lo"])


def _banded(a: Column, b: Column, k: int) -> Column:
    """Edit distance of UTF-32 texts of at least k code points, whose lengths differ by k at most.

    Right where it is k or less; above, some number over k.  Bit j of a word stands for row
    t - k + j in column t.  The distance is followed down the band's lowest diagonal to the
    last row and then along it.
    """
    m, n = (F.octet_length(a) / 4).cast("int"), (F.octet_length(b) / 4).cast("int")
    band = (1 << (2 * k + 1)) - 1
    one = lambda x, j: F.call_function("shiftright", x, j).bitwiseAND(F.lit(1).cast("long")).cast("int")
    inv = lambda x: F.lit(band).cast("long").bitwiseAND(F.bitwise_not(x))

    def step(s: Column, t: Column) -> Column:
        c = _char(b, t)
        bits = F.lit(0).cast("long")
        for j in range(2 * k + 1):
            i = t - k + j
            bits = bits + F.when((i >= 1) & (i <= m) & (_char(a, i) == c), F.lit(1 << j)).otherwise(F.lit(0)).cast("long")
        vp, vn = s["vp"], s["vn"]
        diagonal = lambda x: ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(band).cast("long"))

        def close(d: Column, hp: Column) -> Column:
            hn, below = d.bitwiseAND(vp), F.shiftright(d, 1)
            row = m - t + k
            moved = F.when(t + k <= m, 1 - one(d, F.lit(2 * k))).otherwise(one(hp, row) - one(hn, row))
            return F.struct(hn.bitwiseOR(inv(below.bitwiseOR(hp))).alias("vp"), below.bitwiseAND(hp).alias("vn"), (s["dist"] + moved).alias("dist"))

        live = _let(bits, lambda x: _let(diagonal(x), lambda d: _let(vn.bitwiseOR(inv(d.bitwiseOR(vp))), lambda hp: close(d, hp))))
        return F.when(s["dist"] > 3 * k + 1, s).otherwise(live)  # no row of the band can come back to k

    start = F.struct(F.lit(band - (1 << k) + 1).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).alias("dist"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["dist"])


def within(a: Column, b: Column, k: int = K) -> Column:
    """Whether two strings of at least k code points are within edit distance k."""
    x, y = F.encode(a, "UTF-32"), F.encode(b, "UTF-32")

    def cut(x: Column, y: Column) -> Column:
        free = (F.least(F.octet_length(x), F.octet_length(y)) / 4).cast("int") - k
        return _let(_common(x, y, free, False), lambda p: _let(
            _common(x, y, free - p, True),
            lambda q: _banded(F.substring(x, 4 * p + 1, F.octet_length(x) - 4 * (p + q)), F.substring(y, 4 * p + 1, F.octet_length(y) - 4 * (p + q)), k),
        ))

    close = F.abs(F.char_length(a) - F.char_length(b)) <= k
    apart = ~close | (F.least(F.char_length(a), F.char_length(b)) < k)
    near = _let(x, lambda x: _let(y, lambda y: F.when(_pieces_lost(x, y, k) > k, False).otherwise(cut(x, y) <= k)))
    return F.when(a == b, True).when(apart, False).otherwise(near)


def _pieces_lost(a: Column, b: Column, k: int) -> Column:
    """How many pieces of UTF-32 text a stand in b at no place within k of their own; an edit spoils one at most."""

    def lost(i: Column) -> Column:
        at, size = _segment(i, (F.octet_length(a) / 4).cast("int"), CHECK_PIECES - 1)
        return ~F.contains(F.substring(b, 4 * F.greatest(at - k, F.lit(1)) - 3, 4 * (size + 2 * k)), F.substring(a, 4 * at - 3, 4 * size))

    return F.size(F.filter(F.sequence(F.lit(1), F.lit(CHECK_PIECES)), lost))


# ---- segments --------------------------------------------------------------------------


def _segment(i: Column | int, length: Column, k: int) -> tuple[Column, Column]:
    """Place (from 1) and size of segment i of k + 1: the last ones have one code point more."""
    i = i if isinstance(i, Column) else F.lit(i)
    base, longer = F.floor(length / (k + 1)).cast("int"), F.pmod(length, F.lit(k + 1)).cast("int")
    extra = F.greatest(i - 1 - (k + 1 - longer), F.lit(0))
    return base * (i - 1) + extra + 1, base + F.when(i > k + 1 - longer, 1).otherwise(0)


def _shifts(i: int, delta: int, k: int) -> range:
    """Where a text that is ``delta`` longer may hold segment i, relative to its place (the multi-match-aware choice)."""
    return range(max(-(i - 1), delta - (k + 1 - i)), min(i - 1, delta + (k + 1 - i)) + 1)


def _spots(k: int) -> list[tuple[int, int, int]]:
    """(segment, delta, shift) of every key of a line; the k + 1 under which it is indexed stand first.

    A probe of its own length at a segment's own place is the index entry itself.
    """
    every = [(i, delta, shift) for delta in range(k + 1) for i in range(1, k + 2) for shift in _shifts(i, delta, k)]
    return sorted(every, key=lambda x: x[1:] != (0, 0))


def segment_keys(code: Column, n: Column, k: int) -> list[Column]:
    """Hashes of a line of n code points in UTF-32, one for each of ``_spots``.

    There a place is found at once; in UTF-8 each key would read the line from its start.
    """
    keys = []
    for i, delta, shift in _spots(k):
        at, size = _segment(i, n - delta, k)
        keys.append(F.xxhash64(F.lit(i), n - delta, F.substring(code, 4 * (at + shift) - 3, 4 * size)))
    return keys


def _pieces(text: Column, delta: Column, k: int) -> Column:
    """Structs (hash, entry) of the pieces of a text that is ``delta`` longer than what it is compared with."""

    def piece(j: int) -> Column:
        length = F.char_length(text) - delta
        at, size = _segment(j, length, k)
        low, high = F.greatest(F.lit(1 - j), delta - (k + 1 - j)), F.least(F.lit(j - 1), delta + (k + 1 - j))
        shifts = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.transform(shifts, lambda s: F.struct(F.xxhash64(F.lit(j), length, F.substring(text, at + s, size)).alias("hash"), (s == 0).alias("entry")))

    return F.flatten(F.array(*[piece(j) for j in range(1, k + 2)]))


def second_keys(line: Column, n: Column, spot: Column, k: int) -> Column:
    """Of a line under one of its keys: structs of a second key and whether it is an index entry.

    Lines within k that meet at segment i differ by i - 1 edits at most before it, and by
    k + 1 - i after it.  Where both sides have edits, both must share a piece.
    """
    segment, delta, shift = (F.element_at(F.array(*[F.lit(x[c]) for x in _spots(k)]), spot + 1) for c in range(3))
    place, size = _segment(segment, n - delta, k)
    before, after = F.substring(line, F.lit(1), place + shift - 1), F.substring(line, place + shift + size, n)
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.lit(True).alias("entry")))

    def both(i: int) -> Column:
        left = _pieces(before, shift, i - 1) if i > 1 else nothing
        right = _pieces(after, delta - shift, k + 1 - i) if i < k + 1 else nothing
        pair = lambda x, y: F.struct(F.xxhash64(x["hash"], y["hash"]).alias("second"), (x["entry"] & y["entry"] & (spot <= k)).alias("entry"))
        return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: pair(x, y))))

    found = F.when(segment == 1, both(1))
    for i in range(2, k + 2):
        found = found.when(segment == i, both(i))
    return found


COUNT_CELLS = 16


def code_counts(line: Column) -> Column:
    """How many code points of a line fall into each of COUNT_CELLS cells of their hash."""
    cells = F.transform(F.split(line, ""), lambda c: F.pmod(F.xxhash64(c), F.lit(COUNT_CELLS)).cast("int"))
    return _let(cells, lambda x: F.transform(F.sequence(F.lit(0), F.lit(COUNT_CELLS - 1)), lambda j: F.size(x) - F.size(F.array_remove(x, j))))


# ---- documents and lines ---------------------------------------------------------------


def _placed(docs: DataFrame, doc_id: str, text: str, base: str) -> DataFrame:
    """``docs`` with the place of each text's first line: 0, but apart for texts that share an id or have none."""
    ident, hashed = F.col(f"`{doc_id}`"), F.xxhash64(text)
    own, apart = free_name(docs, "dedup_same_id"), F.shiftleft(F.shiftrightunsigned(hashed, 25), 23)
    texts = docs.where(ident.isNotNull()).select(ident.alias(own), hashed.alias("h")).distinct()
    many = stored(texts.groupBy(own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own))
    many = _few(many, many.count())
    return docs.join(many, ident == F.col(own), "left").withColumn(base, F.when(ident.isNull() | F.col(own).isNotNull(), apart).otherwise(F.lit(0).cast("long"))).drop(own)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    every = docs.select("d", "base", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("d", (F.col("base") + F.col("i")).alias("p"), "line")
    return every.withColumn("n", F.char_length("line")).where(F.col("n") >= min_chars)


def _few(df: DataFrame, rows: int, row_bytes: int = PLACE_BYTES) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= MOST_BROADCAST else df


def _of_places(docs: DataFrame, places: DataFrame, min_chars: int) -> DataFrame:
    """(at, line) of the lines at some places (at)."""
    places = stored(places.select("at").distinct())
    found = _lines(docs, min_chars).select(F.struct("d", "p").alias("at"), "line")
    return found.join(_few(places, places.count()), "at", "left_semi").dropDuplicates(["at"])


def _matches(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (later, earlier) of places of ``texts`` (at, line) whose lines are within k."""
    side = lambda s: texts.select(F.col("at").alias(s), F.col("line").alias(f"line_{s}"))
    both = pairs.select("later", "earlier").distinct().join(side("later"), "later").join(side("earlier"), "earlier")
    return both.where(within(F.col("line_later"), F.col("line_earlier"), k)).select("later", "earlier")


def _shared(met: DataFrame, k: int) -> DataFrame:
    """Of (key, d, p, spot) the rows (key, at, spot) under keys that lines of several places share, one of them as an index entry.

    Each has the key's earliest indexed line and its earliest probing line.  Most keys have
    one line; these go by a count, without a sort.
    """
    met = met.repartition("key")
    indexed, at = F.col("spot") <= k, F.struct("d", "p")
    spread = [F.max(indexed).alias("entry")] + [f(c).alias(f"{f.__name__}_{c}") for c in ("d", "p") for f in (F.min, F.max)]
    keys = met.groupBy("key").agg(*spread, F.count("d").alias("ids"), F.count(F.lit(1)).alias("m"))
    several = "min_d <> max_d or min_p <> max_p or (ids > 0 and ids < m)"  # an id may be null
    few = met.join(keys.where(several).where("entry").select("key").hint("shuffle_hash"), "key")  # one shuffle for both sides, which a semi join would not share
    by = Window.partitionBy("key")
    least = lambda rows: F.min(F.when(rows, at)).over(by)
    return few.select("key", at.alias("at"), "spot", least(indexed).alias("of_index"), least(~indexed).alias("of_probe"))


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, k: int = K, short: bool = False) -> DataFrame:
    """(d, p) of every line of docs (d, base, text) that goes."""
    if min_chars < k + 1:
        raise ValueError("min_chars must be above k")
    lines = _lines(docs, 1 if short else min_chars).withColumn("code", F.encode("line", "UTF-32"))
    keys = F.array(*segment_keys(F.col("code"), F.col("n"), k))
    if short:  # a short line has no keys: only its equals are in its class
        lines = lines.where((F.col("n") >= min_chars) | F.col("line").rlike(r"[^\x20\x09-\x0D]"))
        keys = F.when(F.col("n") >= min_chars, keys).otherwise(F.array().cast("array<bigint>"))
    hashed = lines.select("d", "p", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(k), "line").alias("g"), keys.alias("keys"))
    classes = stored(hashed.groupBy("h", "g").agg(F.min(F.struct("d", "p")).alias("at"), F.count(F.lit(1)).alias("lines"), F.first("keys").alias("keys")))
    met = classes.select("at", F.posexplode("keys").alias("spot", "key")).select("key", "at.d", "at.p", F.col("spot").cast("byte").alias("spot"))
    # Per key: the earliest indexed line meets every row, the earliest probing line every indexed row.
    indexed = F.col("spot") <= k
    shared = stored(_shared(met, k))
    texts = stored(_of_places(docs, shared, min_chars))
    star = shared.select(F.col("at").alias("later"), F.explode(F.array("of_index", F.when(indexed, F.col("of_probe")))).alias("earlier"))
    star = star.where("earlier is not null and earlier < later")
    gone = stored(_matches(star, texts, k).select(F.col("later").alias("at")).distinct())
    # A line that is left may still be near another earlier line of its keys.
    waits = f"of_index < at or (spot <= {k} and of_probe < at)"
    some = shared.join(gone, "at", "left_anti").where(waits).groupBy("key").agg(F.count(F.lit(1)).alias("waiting"))
    some = stored(shared.join(some, "key"))
    loads = some.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    counted = some.select("at").distinct().join(texts, "at").select("at", "line", F.char_length("line").alias("n"), code_counts(F.col("line")).alias("x"))
    some = some.join(loads, "key").join(stored(counted), "at")
    plain = some.where(F.col("m") <= PLAIN_KEY).select("key", F.lit(0).cast("long").alias("second"), indexed.alias("entry"), "at", "spot", "of_index", "of_probe", "x")
    seconds = second_keys(F.col("line"), F.col("n"), F.col("spot"), k)
    many = some.where(F.col("m") > PLAIN_KEY).select("key", F.inline(seconds), "at", "spot", "of_index", "of_probe", "x")
    some = stored(plain.unionByName(many))
    later = some.join(gone, "at", "left_anti").where(waits).select("key", "second", F.col("at").alias("later"), F.col("entry").alias("entry_of_later"), "spot", "of_index", "of_probe", "x")
    other = later.join(some.select("key", "second", F.col("at").alias("earlier"), "entry", F.col("x").alias("y")), ["key", "second"])
    other = other.where("earlier < later and (entry or entry_of_later)").where(f"not (earlier <=> of_index) and not (spot <= {k} and earlier <=> of_probe)")
    other = other.where(F.aggregate(F.zip_with("x", "y", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d) <= 2 * k)
    gone = stored(gone.union(_matches(other, texts, k).select("later")).distinct())
    # A class of one line that is near no other has nothing to drop.
    verdict = classes.select("h", "g", "lines", F.col("at")).join(gone.withColumn("near", F.lit(True)), "at", "left").where("near or lines > 1")
    verdict = verdict.select("h", "g", F.col("at").alias("kept_at"), F.coalesce("near", F.lit(False)).alias("near"))
    at = F.struct("d", "p")
    return hashed.select("h", "g", "d", "p").join(verdict, ["h", "g"]).where(F.col("near") | (at != F.col("kept_at"))).select("d", "p").distinct()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, k: int = K, short: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with the text's dropped lines gone, and an added count column, whose name is returned."""
    base = free_name(docs, "dedup_base")
    placed = _placed(docs, doc_id, text, base)
    gone = duplicate_lines(placed.select(F.col(f"`{doc_id}`").alias("d"), F.col(base).alias("base"), F.col(f"`{text}`").alias("text")), min_chars, k, short)
    name, own, places = free_name(docs, "n_dropped"), free_name(docs, "dedup_id"), free_name(docs, "dedup_places")
    gone = stored(gone.groupBy(F.col("d").alias(own)).agg(F.sort_array(F.collect_list("p")).alias(places)))
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size(places))).first()
    gone = _few(gone, PLACE_BYTES * size[0] + 8 * (size[1] or 0), 1)
    both = placed.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(own)), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(places, F.col(base) + i)), "\n")
    end = F.col(base) + F.size(F.split(text, "\n", -1))  # of the text's own places; found once, not for each place
    dropped = _let(end, lambda e: F.size(F.filter(places, lambda p: (p >= F.col(base)) & (p < e))))
    text_now = F.when(F.col(places).isNull(), F.col(text)).otherwise(kept).alias(text)
    cols = [text_now if c == text else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*cols, F.when(F.col(places).isNull(), 0).otherwise(dropped).cast("long").alias(name)), name


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done, n = deduplicate(docs)
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return done.select("doc_id", F.col(n).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), lines.alias("n_left"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS p, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
c AS (
  SELECT line, length(line) AS n, min(doc_id * 10000000 + p) AS seen
  FROM l WHERE length(line) >= 40 GROUP BY line),
e AS (SELECT line, seen, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS n FROM c),
near AS (SELECT DISTINCT a.line FROM e a JOIN c b ON a.n = b.n AND b.seen < a.seen WHERE levenshtein(a.line, b.line) <= 2),
m AS (
  SELECT l.doc_id, l.p, l.line,
         length(l.line) >= 40 AND (near.line IS NOT NULL OR c.seen <> l.doc_id * 10000000 + l.p) AS gone
  FROM l LEFT JOIN c ON c.line = l.line LEFT JOIN near ON near.line = l.line),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text,
         count(*) FILTER (WHERE NOT gone) AS k
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(g.text, '')) AS text_sha256,
       CASE WHEN d.text IS NULL THEN 0 ELSE greatest(k, 1) END::BIGINT AS n_left
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
