"""The pipeline's stages, each on its own input, against brute force."""

import random
from collections import Counter

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import bpe

from .test_corpus import WORD, brute_classes, brute_lines, brute_targets


def test_stages(spark, tmp_path):
    rnd = random.Random(12)
    tongue = {"en": "the of and thing that with onth erst", "fr": "le des été où être çà eaux pour"}
    rows = []
    for i in range(50):
        lang = rnd.choice(sorted(tongue))
        line = lambda: " ".join(rnd.choice(tongue[lang].split()) + rnd.choice(["", "s", "er", "ne"]) for _ in range(rnd.randint(12, 25)))  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(rnd.randint(1, 4))), lang, f"src{i % 4}"))
    near = rows[3][1].split()
    near[5:6] = ["edited", "words"]
    rows += [(60, rows[3][1], "en", "src0"), (61, " ".join(rows[4][1].split()), "fr", "src1"), (62, rows[5][1] + "\nx", "en", None), (63, None, None, "src1"), (64, "123 !!", "en", "src2"), (65, " ".join(near), "en", "src3")]
    df = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    columns = df.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in df.collect()]
        stage(spark, df, "").write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != "bpe_encode":
            assert df.columns == columns
        seen[name] = (before, df.collect())
    before, after = seen["language_id"]
    assert {i for i, _, _ in before} - {r.doc_id for r in after} == {63, 64}
    before, after = seen["line_dedup"]
    gone = brute_lines([(i, t) for i, t, _ in before], 40, 2)
    left = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t, _ in before}
    kept = {i: t for i, t in left.items() if WORD.search(t)}
    assert {r.doc_id: r.text for r in after} == kept and 60 not in kept and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_duplicates"]
    assert Counter(r.doc_id for r in after) == Counter(i for i, _, c in brute_classes([(i, t) for i, t, _ in before]) if i == c)
    before, after = seen["mix_sources"]
    sizes, taken = Counter(), Counter()
    for _, t, s in before:
        sizes[s] += len(WORD.findall(t))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    target = brute_targets(sizes)
    longest = max(len(WORD.findall(t)) for _, t, _ in before)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    before, after = seen["bpe_encode"]
    ranks = bpe.load_ranks(bpe.public_tokenizers.path(bpe.VOCABULARY))
    other = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((i, tuple(other.encode_ordinary(t))) for i, t, _ in before) == Counter((r.doc_id, tuple(r.ids)) for r in after)
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_line_dedup_drops_short_repeats(spark):
    rnd = random.Random(6)
    short = ["All rights reserved.", "All right reserved.", "Released under the MIT License.", "Was.", "Es.", "a", "", "  ", "é漢", "Ten chars.", "Ten chars!"]
    rows = [(i, "\n".join([f"own {i} " + "".join(rnd.choice("abcdefgh ") for _ in range(50))] + [rnd.choice(short) for _ in range(rnd.randint(0, 5))])) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    gone, seen = brute_lines(rows, 10, 2), set()
    for i, t in rows:
        for p, line in enumerate(t.split("\n")):
            if WORD.search(line) and line in seen:
                gone.add((i, p))
            seen.add(line)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == want and sum(t.count("All rights reserved.") for t in got.values()) <= 1


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "s", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()] == [1]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, and columns whose names clash, in every stage."""
    rnd = random.Random(3)
    words = "the of and thing that with onth erst".split()
    line = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "s", "er"]) for _ in range(n))
    a, b, c, d = (line(40) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, None), (9, ""), (10, " \n "), (11, line(60_000)), (12, a + " more"), (13, "z" * 300_000)]
    clash = ["component", "n_rows", "mix", "mix_src", "ids", "score", "lang_pred", "n_dropped", "near_id", "dedup_base", "root", "text_hash", "node", "n"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in clash:
        df = df.withColumn(name, F.lit("kept"))
    columns = df.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, "").write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        if name != "bpe_encode":
            assert df.columns == columns and all(r[c] == "kept" for r in df.collect() for c in clash)
        kept[name] = Counter((r.doc_id, None if name == "bpe_encode" else r.text) for r in df.collect())
    assert set(kept["language_id"]) == {(i, t) for i, t in rows if t and t.strip()}
    near = kept["near_duplicates"]
    assert near[None, a] + near[12, a + " more"] == 1 and near[None, b] == 1 and near[7, c] == near[7, d] == 1 and near[11, rows[9][1]] == 1
    assert set(kept["mix_sources"]) <= set(near) and max(kept["mix_sources"].values()) <= 2
