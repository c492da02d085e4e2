"""Operators on single documents against brute force, and their edge cases."""

import hashlib
import math
import random
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from keyloom.llm import bpe, langid, pii, quality, registry

from ..conftest import DATA, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two\none two\n\none two"), (5, "one two\none two\n\none two"), (6, "é漢😀 x " * 40), (7, "x" * 200_000), (8, "w " * 30_000)]


def docs(spark, rows=EDGE, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s%d" % (i % 2)) for i, t in rows], "doc_id long, text string, lang string, source string")
    for clash in ("ids", "decoded", "lang_pred", "score", "mix", "n_dropped", "base") if extra else ():
        df = df.withColumn(clash, F.lit("kept"))
    return df


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(name, spark, duck):
    assert same(registry.queries()[name](spark, DATA), duck, registry.oracle_sql()[name])


# ---- personal data ---------------------------------------------------------------------

BASE = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, p in enumerate(BASE):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(d))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m.group().split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("a.@-0123456789+ (é") for _ in range(rnd.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.mark.parametrize(
    "text, span",
    [
        ("mail jo.doe [at] example [dot] com now", ("email", "jo.doe [at] example [dot] com")),
        ("write to jo at example dot com", ("email", "jo at example dot com")),
        ("jо@еxample.com", ("email", "jо@еxample.com")),
        ("call plus one five five five one two three four five six seven ok", ("phone", "plus one five five five one two three four five six seven")),
        ("１２７.0.0.１ x", ("ip", "１２７.0.0.１")),
        ("4111-1111-1111-111​1 x", ("card", "4111-1111-1111-111​1")),
    ],
)
def test_pii_disguises_map_back(text, span):
    base, found = pii.all_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [span] and not base


@pytest.mark.parametrize(
    "text, span",
    [
        ("call plus one, five, five, five, one, two, three, four, five, six, seven ok", ("phone", "plus one, five, five, five, one, two, three, four, five, six, seven")),
        ("jo ät firma.de", ("email", "jo ät firma.de")),
        ("at one two seven dot zero dot zero dot one now", ("ip", "one two seven dot zero dot zero dot one")),
        ("at 127 dot zero dot 0 dot one, two", ("ip", "127 dot zero dot 0 dot one")),
        ("one nine two.one six eight.zero.one. Two", ("ip", "one nine two.one six eight.zero.one")),
        ("one two seven [dot] zero [dot] zero [dot] one", ("ip", "one two seven [dot] zero [dot] zero [dot] one")),
        ("call +1 555 one two three 4567 ok", ("phone", "+1 555 one two three 4567")),
        ("call plus one (five five five) one two three 4567", ("phone", "plus one (five five five) one two three 4567")),
        ("4111 1111 one one one one 1111 x", ("card", "4111 1111 one one one one 1111")),
        ("four.one.one.one." + ".".join(["one"] * 12) + " x", ("card", "four.one.one.one." + ".".join(["one"] * 12))),
        ("plus one five five five one two three four five ſix seven", ("phone", "plus one five five five one two three four five ſix seven")),
        ("plus one five five five one two three four five six seven fourth", ("phone", "plus one five five five one two three four five six seven")),
    ],
)
def test_pii_short_mixed_and_punctuated_runs(text, span):
    base, found = pii.all_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [span] and not base


def test_pii_chains_are_linear_and_leave_prose_alone():
    for t in ("one " * 50_000, "1 one" * 40_000, "one dot " * 25_000, "(one " * 40_000, "plus one, " * 20_000, "one " * 50_000 + "fourth", "(" + "one " * 50_000, "1." * 100_000 + "x"):
        pii.all_spans(t)
    for t in ("in 2001, two of three; 4 dot one", "one dot two dot three", "(one) and 2, three", "rows 1, 2, three, 4, five, 6, 7, eight"):
        assert pii.all_spans(t)[1] == []


def test_pii_random_disguises_map_back():
    """Identifiers under random disguises between random words: the span found is the disguise, whole."""
    rnd = random.Random(21)
    names = "zero one two three four five six seven eight nine".split()
    alike = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с"}
    blur = lambda t: "".join(alike.get(c, c) if rnd.random() < 0.5 else c for c in t)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() and rnd.random() < 0.5 else c for c in t)

    def spelled(digits, sep):
        return sep.join(names[int(c)] if rnd.random() < 0.7 else c for c in digits)

    filler = ["the words", "stand; here", "ünd — dort", "漢字", "(so)", "no numbers."]
    for _ in range(400):
        user, host = "".join(rnd.choices("abcdeop", k=6)), "".join(rnd.choices("abcdeop", k=5))
        at, dot = rnd.choice([" [at] ", " (at) ", " at ", "@"]), rnd.choice([" [dot] ", " (dot) ", " dot "])
        ip = [str(rnd.randrange(1, 256)) for _ in range(4)]
        kind, hidden = rnd.choice([
            ("email", blur(user) + at + host + dot + "com"), ("email", "а" + blur(user) + "@" + host + ".com"), ("ip", " dot ".join(ip)), ("ip", wide("１." + ".".join(ip[1:]))),
            ("ip", " dot ".join(spelled(x, " ") for x in ["1" if rnd.random() < 0.5 else "one", *ip[1:]])), ("phone", "plus " + "one " + spelled("".join(rnd.choices("0123456789", k=10)), rnd.choice([" ", "-", ", "]))),
        ])
        before, after = rnd.choice(filler), rnd.choice(filler)
        text = f"{before} : {hidden} ; {after}"
        base, found = pii.all_spans(text)
        spans = [(pii.KINDS[k], text[a:b]) for a, k, b in found]
        assert (kind, hidden) in spans, (text, spans)


def test_pii_leaves_prose_alone():
    for t in ("one of two, at home. three dots", "we met at noon dot", "un deux trois", "price [.] at (home)"):
        assert pii.all_spans(t)[1] == []


def test_pii_is_linear_and_edge(spark):
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1.2." * 50_000, "+1 " * 50_000, "a@" * 50_000):
        pii.all_spans(t)
    assert pii.find(docs(spark)).count() == len(EDGE)
    assert pii.find(docs(spark, [])).count() == 0
    row = registry.queries()["op1_pii_spans"](spark, DATA).where("n_email + n_ip + n_card + n_phone > 0").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_spans(text))
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(row.spans.split(","))


# ---- language --------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    got = registry.queries()["op2_language_mixture"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert held[0] > 0.95 and 0 <= held[1] <= held[2] <= 1


def test_language_mixture_and_edges(spark):
    words = {"aa": "lorem ipsum dolor sit amet", "bb": "zwölf boxkämpfer jagen quer", "cc": "ñandú corazón mañana sueño"}
    train = spark.createDataFrame([(k, " ".join(random.Random(j).choices(w.split(), k=60)), k) for k, w in words.items() for j in range(5)], "x string, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ("aa", "bb", "cc")
    rows = [(1, None), (2, ""), (3, "123 !!! 漢".replace("漢", "—")), (4, words["aa"] * 9), (5, (words["aa"] + " ") * 30 + (words["bb"] + " ") * 10), (6, words["cc"] * 2000)]
    found, (pred, score, shares) = langid.identify(docs(spark, rows), model)
    got = {r.doc_id: (r[pred], r[score], r[shares]) for r in found.collect()}
    assert found.columns[:4] == ["doc_id", "text", "lang", "source"] and pred == "lang_pred_"
    assert [got[i][0] for i in (1, 2, 3)] == ["und"] * 3 and got[4][0] == "aa" and got[6][0] == "cc"
    assert got[5][0] == "aa" and 0.6 < got[5][1] < 0.9 and got[5][2][1] > 0.1 and got[5][2][2] < 0.05
    none = langid.fit(train.where("lang = 'zz'"))
    assert {r[pred] for r in langid.identify(docs(spark, rows), none)[0].collect()} == {"und"}


def reference_mixture(table, penalty, rounds):
    """One document: units x languages log-likelihoods to shares, by plain EM and a greedy penalised search over all languages."""

    def em(active):
        share = {j: 1 / len(active) for j in active}
        for _ in range(rounds):
            each = [[share[j] * math.exp(row[j] - max(row)) for j in active] for row in table]
            share = {j: sum(e[k] / sum(e) for e in each) / len(table) for k, j in enumerate(active)}
        return share, sum(math.log(sum(share[j] * math.exp(row[j] - max(row)) for j in active)) + max(row) for row in table)

    best = max(range(len(table[0])), key=lambda j: sum(row[j] for row in table))
    active, score = [best], sum(row[best] for row in table)
    while True:
        tried = [(em(active + [j]), j) for j in range(len(table[0])) if j not in active]
        (_, ll), j = max(tried, key=lambda x: x[0][1], default=((None, -math.inf), None))
        if ll - penalty <= score:
            return em(active)[0]
        active, score = active + [j], ll - penalty


def test_language_mixture_equals_reference(spark):
    rnd = random.Random(17)
    tongues = {f"l{k}": ["".join(rnd.choices("abcdefghijklmnop"[k : k + 8], k=rnd.randint(3, 8))) for _ in range(30)] for k in range(7)}
    train = spark.createDataFrame([(" ".join(rnd.choices(w, k=80)), k) for k, w in tongues.items() for _ in range(4)], "text string, lang string")
    model = langid.fit(train)
    texts = []
    for _ in range(60):
        parts = rnd.sample(sorted(tongues), rnd.choice([1, 2, 3, 5, 6]))
        texts.append(" ".join(w for p in parts for w in rnd.choices(tongues[p], k=rnd.randint(8, 60))))
    pred, score, shares = langid.infer(model, langid.pa.array(texts))
    several = 0
    for i, t in enumerate(texts):
        cells, at, _, size, _ = langid._evidence(langid.pa.array([t]))
        table = [[float(model.scores[cells[a : a + n], j].sum(dtype=float)) for j in range(7)] for a, n in zip(at, size)]
        want = reference_mixture(table, 0.5 * math.log(max(len(table), 2)) + 1, langid.ROUNDS)
        several += len(want) > 4
        assert all(abs(shares[i][j] - want.get(j, 0)) < 1e-3 for j in range(7)), (i, want, shares[i])
        assert pred[i] == model.langs[max(want, key=want.get)] and abs(score[i] - max(want.values())) < 1e-3
    assert several >= 5


# ---- byte-level BPE --------------------------------------------------------------------


def test_bpe_equals_tiktoken():
    ranks = bpe.load_ranks(bpe.public_tokenizers.path(bpe.VOCABULARY))
    own, back = bpe.Replay(ranks), bpe.Bytes(ranks)
    other = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice('aàb c<|>\n\t 1é漢"n\'s  ') for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, " " * 4000, "ｅ" * 500, "the" * 900, "x\n ", "<|endoftext|>", "It's we'll"]
    for t, ids in zip(texts, own.encode(texts)):
        assert list(ids) == other.encode_ordinary(t), repr(t)
        assert back.decode(ids) == t.encode()
    bpe.MEMO_WORDS, most = 50, bpe.MEMO_WORDS
    try:
        assert [list(x) for x in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]
    finally:
        bpe.MEMO_WORDS = most


def test_bpe_frames(spark):
    encoded = bpe.encode(docs(spark))
    assert encoded.columns[-1] == "ids_"
    back = bpe.decode(encoded, ids="ids_")
    for r in back.collect():
        assert bytes(r["decoded_"]) == (r.text or "").encode()
    assert bpe.encode(docs(spark, [])).count() == 0
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing).first().decoded is None
    with pytest.raises(ValueError):
        bpe.Bytes({b"a": 0}).decode(bpe.np.array([5]))
    row = registry.queries()["op4_bpe_round_trip"](spark, DATA).orderBy("doc_id").first()
    text = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").first().text
    assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- quality ---------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {g: grams.count(g) for g in set(grams)} if len(grams) < 500 else {g: 2 for g in grams}
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_counts(spark):
    rnd = random.Random(2)
    rows = EDGE + [(100 + k, "".join(rnd.choice("ab é#$\n\t \x0b") for _ in range(rnd.randint(0, 90)))) for k in range(300)]
    got = quality.measure(docs(spark, rows)).collect()
    want = sorted((i, *brute_quality(t)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_host_verdicts(spark):
    good, bad = " ".join(f"w{k}" for k in range(80)), "short"
    rows = [(i, good, "good") for i in range(50)] + [(100 + i, bad, "bad") for i in range(50)] + [(200, good, "bad"), (201, bad, "good"), (202, good, None), (203, None, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.apply_rules(df).collect()}
    assert kept[0] and not kept[100] and not kept[200] and not kept[201] and kept[202] and not kept[203]
    rates = {r.host: r.host_rate for r in quality.host_verdicts(quality.measure(df).withColumn("base_failed", quality.base_failed())).collect()}
    verdict = {r.host: r.host_kept for r in quality.host_verdicts(quality.measure(df).withColumn("base_failed", quality.base_failed())).collect()}
    assert verdict["good"] and not verdict["bad"]
    assert rates["tiny"] < 1 and rates["good"] < rates["tiny"] <= rates["bad"] + 0.05
    assert quality.apply_rules(df.limit(0)).count() == 0
    clash = df.withColumn("host", F.lit("x")).withColumn("n_words", F.lit("y")).withColumn("kept", F.lit("z"))
    assert {r.doc_id: r.kept for r in quality.apply_rules(clash).collect()} == kept


def test_host_verdict_binds_on_real_rows(spark):
    got = registry.queries()["host_rules_by_length"](spark, DATA)
    assert got.where("kept <> not base_failed").count() > 0
