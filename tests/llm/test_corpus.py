"""Operators on whole tables against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import ann, bpe, linededup, mixing, preferences, quality, rollup, shingle_join
from keyloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


# ---- nearest neighbours ----------------------------------------------------------------


def test_ann_recall_ties_and_edges(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)]
    rows += [(1000 + k, rows[7][1]) for k in range(30)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (None, rows[3][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<float>, score string")
    queries = df.where("vec_id % 20 = 7 or vec_id >= 2000")
    got = defaultdict(list)
    for r in ann.search(df, queries).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = {i: np.array(y, np.float64) for i, y in rows if i is not None and i < 2000 and y}
    hit = n = 0
    for q, found in got.items():
        best = sorted(((-float(x[q] @ c / np.linalg.norm(x[q]) / np.linalg.norm(c)), i) for i, c in x.items() if i != q))[:5]
        hit += len({i for _, i in best} & {i for i, _ in found})
        n += 5
        assert len(found) == 5 and found == sorted(found, key=lambda f: (-f[1], f[0])) and q not in dict(found)
        assert all(abs(s - x[q] @ x[i] / np.linalg.norm(x[q]) / np.linalg.norm(x[i])) < 1e-12 for i, s in found)
    assert hit / n >= 0.9 and not {q for q in got if q >= 2000}
    assert [i for i, _ in got[7]] == [1000, 1001, 1002, 1003, 1004]
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert len(few) == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_ann_lone_queries_among_copies(spark):
    rng = np.random.default_rng(1)
    lone = rng.normal(size=(200, 16))
    x = {i: v for i, v in enumerate(lone)}
    for c, center in enumerate(rng.normal(size=(40, 16))):  # most rows in tight near copies or in copies
        for k in range(24):
            x[1000 + 24 * c + k] = center + (rng.normal(size=16) * 1e-4 if c % 2 else 0)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id < 200 and vec_id % 4 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, 200, 4):
        cos = {i: float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)) for i, v in x.items() if i != q}
        fifth = sorted(cos.values())[-5]
        assert len(got[q]) == 5
        hit += sum(cos[i] >= fifth - 1e-9 for i in got[q])
    assert hit / 250 >= 0.9, hit / 250
    print("recall of lone queries", hit / 250)


# ---- line dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rnd = random.Random(k)
    rows = []
    for _ in range(600):
        a = "".join(rnd.choice("abé漢😀") for _ in range(rnd.randint(3, 30)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["a"], ["é"]])
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), k).alias("w")).collect()
    assert all(r.w == (lev(r.a, r.b) <= k) for r in got if min(len(r.a), len(r.b)) >= k)


def brute_lines(rows, least, k):
    flat = sorted((-1 if i is None else i, p, line) for i, t in set(rows) if t is not None for p, line in enumerate(t.split("\n")) if len(line) >= least)
    return {(i, p) for n, (i, p, line) in enumerate(flat) if any(abs(len(o) - len(line)) <= k and (o == line or lev(o, line) <= k) for _, _, o in flat[:n])}


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(8, 20))) for _ in range(12)]

    def edit(s):
        s = list(s)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(s))
            s[at : at + 1] = rnd.choice([[], ["x"], [s[at], "y"]])
        return "".join(s)

    rows = [(i, "\n".join(rnd.choice([edit(rnd.choice(base)), "short", ""]) for _ in range(rnd.randint(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, base[0]), (102, "z" * 400), (103, "z" * 401), rows[0]]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, n_dropped string")
    done, name = linededup.deduplicate(df, min_chars=8)
    gone = brute_lines(rows, 8, 2)
    want = Counter((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (-1 if i is None else i, p) not in gone)) for i, t in rows)
    assert Counter((r.doc_id, r.text) for r in done.collect()) == want
    assert name == "n_dropped_" and linededup.deduplicate(df.limit(0))[0].count() == 0


def test_line_dedup_popular_segments(spark, monkeypatch):
    """Lines that share a third and differ elsewhere: edits on both sides are found by the second keys, and few pairs are made."""
    monkeypatch.setattr(linededup, "PLAIN_KEY", 3)
    rnd = random.Random(5)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    rows = []
    for letters in ("0123456789", "漢字仮名交じり文", "abcdefgh "):
        first, middle, last = word(letters, 12), word(letters, 12), word(letters, 12)
        lines = [first + word(letters, 24) for _ in range(14)] + [word(letters, 12) + middle + word(letters, 12) for _ in range(14)] + [word(letters, 24) + last for _ in range(14)]
        for line in list(lines):
            for _ in range(2):
                s = list(line)
                for _ in range(rnd.choice([1, 2, 2, 3])):
                    at = rnd.randrange(len(s))
                    s[at : at + 1] = rnd.choice([[], [rnd.choice(letters)], [s[at], rnd.choice(letters)]])
                lines.append("".join(s))
        rnd.shuffle(lines)
        rows += [(len(rows) + k, "\n".join(lines[5 * k : 5 * k + 5])) for k in range(len(lines) // 5 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines(rows, 8, 2)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}
    assert {r.doc_id: r.text for r in linededup.deduplicate(df, min_chars=8)[0].collect()} == want


def test_line_dedup_tells_documents_without_own_ids_apart(spark):
    a, b, c = ("line %s that is long enough" % x for x in ("one - aaaa", "two - bbbb", "six - cccc"))
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (None, f"{c}\n{a}"), (5, f"{b}\n5 {'x' * 30}"), (5, f"own {'y' * 40}\n{c}"), (6, None), (7, ""), (8, "z" * 300_000 + f"\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done, n = linededup.deduplicate(df)[0].collect(), "n_dropped"
    done = linededup.deduplicate(df, min_chars=20)[0].collect()
    left = Counter(line for r in done if r.text for line in set(r.text.split("\n")))
    texts = {r.text for r in done if r.doc_id is None}
    assert left[b] == 1 and any(b in t for t in texts) and left[c] == 2 and left[a] in (1, 2) and not any(a in t for t in texts if b not in t and c not in t)
    assert all(r[n] == (t or "").count("\n") - (r.text or "").count("\n") for r in done for i, t in rows if r.doc_id == i and r.doc_id in (6, 7, 8))
    five = sorted(r.text for r in done if r.doc_id == 5)
    assert five == [f"5 {'x' * 30}", f"own {'y' * 40}"]
    assert [r.text for r in done if r.doc_id == 8] == ["z" * 300_000]


@pytest.mark.parametrize("k", [1, 2])
def test_banded_distance_of_long_lines(spark, k):
    """Lines of which pieces are looked at first: scattered edits, a changed word, repeating text, moved ends."""
    rnd = random.Random(10 + k)
    rows = []
    for letters in ("ab", "abcdefgh é漢😀"):
        for n in range(150):
            a = "".join(rnd.choice(letters) for _ in range(rnd.randint(20, 90)))
            a = (a[: rnd.randint(1, 4)] * 60)[: len(a)] if n % 5 == 0 else a
            b = list(a)
            for _ in range(rnd.randint(0, k + 2)):
                at = rnd.choice([0, len(b) - 1, rnd.randrange(len(b)), rnd.randrange(len(b))])
                b[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["a"], ["é"]])
            if n % 7 == 0:
                at = rnd.randrange(len(b))
                b[at : at + 5] = rnd.choices(letters, k=5)
            rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), k).alias("w")).collect()
    want = [lev(r.a, r.b) <= k for r in got]
    assert [r.w for r in got] == want and 50 < sum(want) < len(want) - 50


def test_line_dedup_cuts_texts_twice(spark, monkeypatch):
    """Texts are cut into lines for the classes and for the lines that share a key, and not again for each step that compares some."""
    cut, lines = [], linededup._lines
    monkeypatch.setattr(linededup, "_lines", lambda *a: cut.append(a) or lines(*a))
    line = "a line that is long enough to be compared, number %d of a few"
    rows = [(i, "\n".join([line % i, line % (70 + i), "another one - " + "xyz"[i % 3] * 40])) for i in range(12)]
    gone = brute_lines(rows, 40, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in linededup.deduplicate(df)[0].collect()} == {i: sum(g == i for g, _ in gone) for i, _ in rows}
    assert len(cut) == 2


def test_shared_keys_go_by_a_count(spark):
    """Keys of one place are not sorted or joined by sorting, and one shuffle serves the count and the rows."""
    rnd = random.Random(3)
    rows = {(rnd.randrange(40), rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(3), rnd.randrange(12)) for _ in range(90)}
    rows |= {(100, 1, 1, 0), (100, 1, 1, 5), (101, None, 4, 0), (101, None, 5, 7), (102, None, 4, 1), (102, 6, 4, 8), (103, 1, 0, 4), (103, 2, 0, 5)}
    shared = linededup._shared(spark.createDataFrame(sorted(rows, key=str), "key long, d long, p long, spot byte"), 2)
    order = lambda x: (-1 if x[0] is None else x[0], x[1])
    want = Counter()
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        index, probe = ([r[1:3] for r in mine if (r[3] <= 2) == side] for side in (True, False))
        if index and len({r[1:3] for r in mine}) > 1:
            want.update((key, r[1:3], r[3], min(index, key=order), min(probe, key=order) if probe else None) for r in mine)
    whole = lambda x: x if x is None else tuple(x)
    assert Counter((r.key, tuple(r.at), r.spot, whole(r.of_index), whole(r.of_probe)) for r in shared.collect()) == want and len(want) > 40
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan


# ---- shingle join ----------------------------------------------------------------------


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return Counter((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(k).count("1") & 1] for k in range(n))


def test_hashes_keep_complements_apart(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64."""
    words = [thue_morse(n, x) for n in (64, 1024, 2048, 4096) for x in ("ab", "ba")]
    rows = [(k, w) for k, w in enumerate(words)] + [(20, " ".join(words)), (21, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in shingle_join.classes(df).collect()) == brute_classes(rows)
    lines = spark.createDataFrame([(1, "\n".join(words), "s"), (2, "\n".join(words + words[:3]), "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_dup_lines for r in quality.measure(lines).collect()} == {1: 0, 2: 3}


def test_shingle_join_one_shared_passage(spark, monkeypatch):
    """Many documents that share a passage without linking: no task sees them all, and links between them are found."""
    monkeypatch.setattr(shingle_join, "CHUNK_MEMBERS", 16)
    rnd = random.Random(11)
    passage = [f"p{k}" for k in range(80)]
    own = lambda i, n: [f"d{i}x{k}" for k in range(n)]
    rows = [(i, " ".join(own(i, rnd.randint(8, 40)) + passage[: rnd.randint(60, 80)])) for i in range(150)]
    rows += [(500 + k, rows[3 * k][1] + " tail") for k in range(20)] + [(600, " ".join(own(600, 20_000) + passage)), (601, " ".join(own(600, 20_000) + passage + ["more"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in shingle_join.classes(df).collect()) == brute_classes(rows)


@pytest.mark.parametrize("block, chunk", [(300, 7), (1_000_000, 1500)])
def test_shingle_join_equals_brute_force(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(shingle_join, "CHUNK_MEMBERS", chunk)
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(900)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = []
    for size in (30, 60, 120):
        base = text(size)
        for _ in range(25):
            d = list(base)
            for _ in range(rnd.randint(0, 1 + size // 50)):
                at = rnd.randrange(len(d))
                d[at : at + 1] = rnd.choice([[], ["new"], [d[at], "Extra"]])
            rows.append((len(rows), " ".join(d)))
    passage = text(60)
    rows += [(200 + k, " ".join(text(rnd.randint(5, 50)) + passage + text(rnd.randint(0, 15)))) for k in range(40)]
    rows += [(300, ""), (301, None), (302, "a b"), (303, "A\tb "), (304, "a b c d e"), (305, "  "), (306, "x " * 5000), (307, "x " * 6000), rows[0], rows[60]]
    df = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, component_id string")
    assert Counter(tuple(r) for r in shingle_join.classes(df).collect()) == brute_classes(rows)
    if block > 300:
        assert shingle_join.classes(df.limit(0)).count() == 0


def test_signature_tree_prunes_and_is_exact():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 62, 80).astype(np.uint64))
        sets += [np.unique(np.concatenate((rng.choice(base, int(len(base) * 0.93), replace=False), rng.integers(0, 1 << 62, 3).astype(np.uint64)))) for _ in range(6)]
    roots, compared = shingle_join.links_within(sets, 75)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert roots[a] == roots[b]
            elif a // 6 != b // 6:
                assert roots[a] != roots[b]
    assert compared < len(sets) * (len(sets) - 1) / 8
    assert (shingle_join.links_within(sets, 75, 17)[0] == roots).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(200, 260)] + [(rnd.randrange(100), rnd.randrange(100)) for _ in range(60)] + [(500, k) for k in range(501, 600)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- mixing ----------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, free, words = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = words / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            words -= target[s]
            free.remove(s)
    return target


def test_mixing_targets_quotas_and_edges(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 20, 40])), rnd.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(400)]
    rows += [(1000, None, "zero"), (1001, "", None), (None, "x y", "b"), rows[0]]
    df = spark.createDataFrame([(i, t, s, "kept") for i, t, s in rows], "doc_id long, text string, source string, mix string")
    drawn, name = mixing.draw(df)
    got = drawn.collect()
    assert name == "mix_" and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = brute_targets(sizes)
    taken = Counter()
    for r in got:
        m = r[name]
        assert m.size == len(WORD.findall(r.text or "")) and m.source_size == sizes[r.source]
        assert abs(m.target - target[r.source]) < 1e-6 and len(m.draws) <= 2
        assert all(0 <= d.shard < 16 for d in m.draws)
        taken[r.source] += m.size * len(m.draws)
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    again = mixing.draw(df.repartition(7))[0].collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))
    mixed, place = mixing.mix(df)
    assert mixed.count() == sum(len(r[name].draws) for r in got)
    shards = mixed.groupBy(F.col(place)["shard"]).agg(F.sum(mixing.word_count("text"))).collect()
    assert len(shards) == 16
    assert mixing.draw(df.limit(0))[0].count() == 0


def brute_shards(quotas, levels, seed):
    """The shard of each block of each source, by one draw after the other."""
    md5 = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    nodes = {0: dict(quotas)}
    for level in range(levels):
        below = {}
        for node, own in nodes.items():
            tokens = sorted((md5(seed, node + (1 << level), k, i), k) for k, q in own.items() for i in range(1, q + 1))
            for side, part in enumerate((tokens[: len(tokens) // 2], tokens[len(tokens) // 2 :])):
                below[2 * node + side] = Counter(k for _, k in part)
        nodes = below
    out = {}
    for k, q in quotas.items():
        permuted = sorted(range(q), key=lambda b: md5(seed, "block", k, b))
        shards = [s for s in sorted(nodes) for _ in range(nodes[s].get(k, 0))]
        assert len(shards) == q
        out[k] = [s for _, s in sorted(zip(permuted, shards))]
    return out


def test_tree_deals_every_block_once(spark):
    sizes = spark.createDataFrame([(False, "a", 1000), (False, "b", 500), (True, "", 10), (False, "none", 0)], "null boolean, src string, size long")
    plan = mixing.source_plan(sizes, (5.0, 2.0, 1.0), 1.5, 2.0, 3, 16, 7).collect()
    load = Counter(s for r in plan for s in r.shards)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 3
    total = sum(r.target for r in plan)
    assert all(len(r.shards) == -(-r.target // (total / 128)) for r in plan)
    of = {(False, "a"): 0, (False, "b"): 1, (False, "none"): 2, (True, ""): 3}
    want = brute_shards({of[r.null, r.src]: len(r.shards) for r in plan if r.shards}, 3, 7)
    assert all(list(r.shards) == want.get(of[r.null, r.src], []) for r in plan)


def test_draws_follow_the_blocks(spark):
    """Shard and place of every draw against one sequential pass; blocks are disjoint, quotas exact."""
    rnd = random.Random(13)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 9, 30])), rnd.choice("aaab")) for i in range(300)] + [(999, "long " * 20_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn, name = mixing.draw(df, levels=2, per_shard=8)
    got = {r.doc_id: r[name] for r in drawn.collect()}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = brute_targets(sizes)
    block = max(sum(target.values()) / 32, 1.0)
    quotas = {k: int(-(-target[s] // block)) for k, s in enumerate("ab")}
    shards = brute_shards(quotas, 2, 7)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for k, s in enumerate("ab"):
        at = 0
        for key, i, size in sorted((md5(f"{i}:7"), i, len(t.split())) for i, t, x in rows if x == s):
            want = []
            for copy in (0, 1):
                o = at + copy * sizes[s]
                if 2 * o + size < 2 * target[s]:
                    want.append((copy, shards[k][min(int(o * quotas[k] / target[s]), quotas[k] - 1)], int(md5(f"{key}:{copy}")[:15], 16)))
            assert [tuple(d) for d in got[i].draws] == want
            at += size


# ---- preferences -----------------------------------------------------------------------


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", "é"),
        (1, "chosen", 1, "assistant", "yes"), (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"), (3, "chosen", 0, None, None), (None, "chosen", 0, "user", "x"), (4, "odd", 0, "user", "x"), (5, "chosen", None, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "pair long, side string, turn long, role string, text string, prompt string")
    got = {r.pair: r for r in preferences.format_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_common == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\nyes<|end|>\n"
    assert [one.chosen[a:b] for a, b in one.chosen_mask] == ["yes<|end|>\n"] and [one.rejected[a:b] for a, b in one.rejected_mask] == ["no<|end|>\n"]
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_common == 0 and got[3].prompt == "" and got[3].rejected == "" and got[3].chosen == "<||>\n<|end|>\n"
    assert preferences.format_pairs(df.limit(0)).count() == 0
    long = spark.createDataFrame([(9, s, 0, "assistant", "é" * 300_000 + s) for s in ("chosen", "rejected")], "pair long, side string, turn long, role string, text string")
    far = preferences.format_pairs(long).first()
    assert far.n_common == 0 and far.chosen[far.chosen_mask[0].start : far.chosen_mask[0].end] == "é" * 300_000 + "chosen<|end|>\n"


def test_answered_otherwise(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (0, 2, "user", "thanks"), (1, 0, "assistant", "b"), (1, 1, "assistant", "c"),
        (2, 0, "user", "alone"), (4, 0, "assistant", "same"), (5, 0, "assistant", "same"), (None, 0, "user", "x"), (6, None, "user", "x"), (8, 0, None, None), (9, 0, "assistant", None),
    ]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    made = {r.pair: r for r in preferences.format_sides(preferences.answered_otherwise(df)).collect()}
    assert set(made) == {0, 1, 2, 4, 5, 8, 9}
    show = lambda *turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    assert (made[0].prompt, made[0].chosen, made[0].rejected) == (show(("user", "q")), show(("assistant", "a"), ("user", "thanks")), show(("assistant", "c"), ("user", "thanks")))
    assert (made[1].prompt, made[1].chosen, made[1].rejected) == (show(("assistant", "b")), show(("assistant", "c")), show(("assistant", "a")))
    assert made[2].n_common == 1 and made[4].n_common == 1 and made[4].chosen == made[4].rejected == ""
    assert preferences.answered_otherwise(df.limit(0)).count() == 0


# ---- rollups ---------------------------------------------------------------------------


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    kind = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(rows, kind)
    store = rollup.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().count() == 0
    first = batch(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, "en", "v1", 7, None), ("insert", "a", "en", "v1", None, None))
    assert store.commit("b1", first) and not store.commit("b1", first)
    assert store.commit("b2", batch(("delete", "a", "en", "v1", None, 5), ("revise", "a", "en", "v1", 12, 10), ("delete", None, "en", "v1", None, 7)))
    assert store.commit("b3", batch().limit(0))
    want = {("a", "en", "v1", 2, 12)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want and not store.commit("b2", first)
    assert store.commit("b4", batch(("insert", "a", "en", "v2", 3, None)))
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want | {("a", "en", "v2", 1, 3)}
    half = rollup.signed(batch(("insert", "x", "en", "v1", 1, None))).groupBy(*rollup.GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    half.write.parquet(str(tmp_path / "r/batches/b5"))
    (tmp_path / "r/batches/b5/_SUCCESS").unlink()
    assert {tuple(r) for r in store.totals().collect()} == want | {("a", "en", "v2", 1, 3)}
    assert store.commit("b5", batch(("insert", "y", "en", "v1", 1, None)))
    assert store.totals().where("source = 'y'").count() == 1 and store.totals().where("source = 'x'").count() == 0
    with pytest.raises(Exception, match="unknown operation"):
        store.commit("b6", batch(("upsert", "a", "en", "v1", 1, None)))
    with pytest.raises(ValueError):
        store.commit("a/b", first)


def test_token_rollup_equals_brute_force(spark):
    """Counts by two tokenizers against tiktoken, through inserts, deletes, revisions and a batch sent twice."""
    import tiktoken

    rnd = random.Random(8)
    text = lambda: "".join(rnd.choice(["The ", "naïve  ", "\n\t", "été ", "漢字", "x" * 30, "don't ", " "]) for _ in range(rnd.randint(0, 30)))
    rows = [(i, rnd.choice([text(), text(), None, ""]), rnd.choice(["en", None]), rnd.choice("ab")) for i in range(80)] + [(13, "twice here", "en", "a")] * 2 + [(97, "word  " * 40_000, "en", "a")]
    df = spark.createDataFrame([(*r, "kept", "kept") for r in rows], "doc_id long, text string, lang string, source string, counts string, now string")
    ids = {}
    for name, file in rollup.TOKENIZERS.items():
        ids[name] = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.public_tokenizers.path(file)), special_tokens={}).encode_ordinary
    want, docs = Counter(), Counter()
    for i, t, lang, source in rows:
        if i % 10 != 3:
            t = re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "") if i % 10 == 7 else t or ""
            name = list(ids)[i % 10 == 9]
            want[source, lang, name] += len(ids[name](t))
            docs[source, lang, name] += 1
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup._maintained(spark, *rollup.token_deltas(df)).collect()}
    assert got == {k: (docs[k], want[k]) for k in docs}
    assert rollup._maintained(spark, *rollup.token_deltas(df.limit(0))).count() == 0
