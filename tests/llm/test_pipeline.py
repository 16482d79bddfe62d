"""Every stage of the pipeline on its own input, against plain versions."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from gleaner.llm import bpe


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("tables")
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(60, 160)) + "." for _ in range(120)]
    texts[40] = texts[3]
    texts[41] = texts[4].replace(texts[4].split()[30], "changed", 1)
    for i in (60, 61, 62):
        texts[i] = prose(rng, 40) + " " + passage + " " + prose(rng, 40)
    texts += ["".join(w + "$$$ " for w in prose(rng, 80).upper().split()) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 4}", len(t), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"{at}", texts


def near_groups(texts):
    """The least place that pairs at four fifths of their five-word shingles reach, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    least = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    return least


def without_repeats(texts):
    """Words left of each text, by id, without those of 20-word windows that came before."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = texts[i].split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        out[i] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def test_stages(spark, tables):
    sf, texts = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipe.STAGES)
    one = stages["quality classifier"](spark, docs, sf).cache()
    assert {r.doc_id for r in one.collect()} == set(range(120)) and one.columns == list(pipe.COLUMNS)
    two = stages["simhash near-dedup"](spark, one, sf).cache()
    ids = {r.doc_id for r in two.collect()}
    assert ids == set(near_groups(texts[:120])) and 40 not in ids and 3 in ids
    three = stages["substring dedup"](spark, two, sf).cache()
    got = {r.doc_id: r for r in three.collect()}
    left = without_repeats({i: texts[i] for i in ids})
    assert {i: r.text.split() for i, r in got.items()} == left and all(r.n_chars == len(r.text) for r in got.values())
    assert len(left[60]) == 140 and len(left[61]) <= 80 + 2
    four = stages["mixing sources to target weights"](spark, three, sf).cache()
    mix = four.collect()
    sizes = {s: sum(len(w) for i, w in left.items() if i % 4 == s) for s in range(4)}
    assert abs(sum(len(r.text.split()) for r in mix) - 1.5 * sum(sizes.values())) <= 4
    assert all(left[r.doc_id][: len(r.text.split())] == r.text.split() for r in mix)
    for s, n in sizes.items():
        assert sum(len(r.text.split()) for r in mix if r.source == f"s{s}") <= 2 * n
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(bpe.RANKS)), special_tokens={})
    five = stages["byte-level bpe"](spark, four, sf).collect()
    said = sorted((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in five)
    assert said == sorted((r.doc_id, tuple(enc.encode_ordinary(r.text)), len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mix)


def test_odd_rows_in_every_stage(spark, tables):
    """Nulls in every column, empty and very long texts, rows that repeat."""
    sf, texts = tables
    long = "a b" * 300_000
    rows = [(None, None, None, None, None), (None, texts[0], None, None, 3), (7, texts[0], "en", None, 3), (7, texts[0], "en", None, 3), (8, "", None, "s", 0), (9, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1)).withColumn("sig", F.lit(2))
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf).collect()
        assert out and (name == "byte-level bpe" or list(out[0].asDict()) == list(pipe.COLUMNS)), name


def test_run_and_empty(spark, tables, tmp_path):
    sf, _ = tables
    assert pipe.run(spark, sf).count() > 100
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0


def test_nulls(spark, tables):
    sf, texts = tables
    rows = [(None, None, None, None, None), (None, "a b", "en", None, 3), (1, "a b", "en", None, 3), (1, "a b", "en", None, 3), (2, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    two = pipe.simhash_near_dedup(spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in two) == [(1, "a b"), (2, "")]
    three = pipe.substring_dedup(spark, docs, sf)
    assert three.count() == 5
    four = pipe.source_mixing(spark, docs, sf)
    pipe.byte_bpe(spark, four, sf).collect()


def test_near_copies_at_four_fifths(spark, tmp_path):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(60)]
    for i in range(240):
        words = texts[rng.randrange(len(texts) if i % 2 else 60)].split()
        for at in rng.sample(range(len(words)), rng.randint(1, 4)):
            words[at] = f"changed{i}x{at}"
        texts.append(" ".join(words))
    texts += ["a b c", "a b c", "a b d", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    least = near_groups(texts)
    got = {r.doc_id for r in pipe.simhash_near_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == set(least) and 60 < len(got) < 280
