"""Tokens, fingerprints, windows, statistics and mixing against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import bpe, classifier, mixing, outliers, simhash, stats, substring
from gleaner.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, first=0, source=None):
    rows = [(first + i, t, "en", source(i) if source else "s", None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path(bpe.RANKS), P.PATTERN)


ODD = ["", " ", "a", "  a   b ", "a\n \nb", "it's we'll 'x", "ééé 漢字 😀😀", "x" * 5000, " " * 300 + "y", "12 3½²", "\x1c a\x85\xa0b", "<|endoftext|>a<|endoftext|>", "A\u0000B"]


def test_bpe_like_the_libraries(codec):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    parts = [*ODD, " the", "ing", "\n", "\t", "  ", "ü", "'ll", "9", "_"]
    for text in [*ODD, *("".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(1500))]:
        ids = enc.encode_ordinary(text)
        assert codec.encode(text) == ids and codec.decode(ids) == text.encode()


def test_bpe_append_edit_and_prefixes(codec):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    whole = b"internationalisation"
    dp = bpe.PieceDP(codec, whole[:5])
    dp.append(whole[5:])
    assert dp.ids() == bpe.PieceDP(codec, whole).ids()
    for n in range(1, len(whole) + 1):
        assert len(dp.ids(n)) == dp.count[n] == len(enc._encode_single_piece(whole[:n]))
    dp.edit(5, 8, b"XYZ")
    assert dp.data == b"interXYZionalisation" and dp.ids() == bpe.PieceDP(codec, dp.data).ids()
    rng = random.Random(12)
    for _ in range(60):
        data = bytes(rng.choices(b"abcdeilnorst", k=rng.randint(0, 500)))
        dp = bpe.PieceDP(codec, data)
        for _ in range(3):
            i = rng.randint(0, len(data))
            j, new = rng.randint(i, min(len(data), i + 5)), bytes(rng.choices(b"aeixyz", k=rng.randint(0, 5)))
            dp.edit(i, j, new)
            data = data[:i] + new + data[j:]
            plain = bpe.PieceDP(codec, data)
            assert (dp.data, dp.last, dp.count) == (data, plain.last, plain.count)
    assert bpe.PieceDP(codec, whole * 1000).edit(10, 12, b"XYZ") <= 8 * codec.longest  # of 20,000 bytes


def test_prefix_counts_and_edits_of_texts(codec):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(13)
    parts = [*(t for t in ODD if len(t) < 100), "'re", "'r", "''ve", "\n\n x", " the", "\t", "  ", "'"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        counts, want = bpe.PrefixCounts(codec, text), [len(enc.encode_ordinary(text[:i])) for i in range(len(text) + 1)]
        assert [counts.count(i) for i in range(len(text) + 1)] == want
        for budget in range(max(want) + 2):
            assert counts.cut(budget) == max(i for i, n in enumerate(want) if n <= budget)
        kept = bpe.TextTokens(codec, text)
        for _ in range(3):
            i = rng.randint(0, len(text))
            j, new = rng.randint(i, min(len(text), i + 4)), "".join(rng.choices(parts, k=rng.randint(0, 2)))
            kept.edit(i, j, new)
            text = text[:i] + new + text[j:]
            assert kept.text == text and kept.ids() == enc.encode_ordinary(text)
        kept.append("'ll x")
        assert kept.ids() == enc.encode_ordinary(text + "'ll x")
    assert bpe.TextTokens(codec, "word and more, " * 3000).edit(10, 12, "XY z") < 12


def test_token_counts_like_the_library(spark, codec):
    """The table of counts against the library: whole texts and every prefix of them."""
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(14)
    parts = [*(t for t in ODD if len(t) < 400), bpe.SPECIAL, bpe.SPECIAL, "'re", " the", "ab-" * 9, "\n ", "<|endof"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(250)]
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = {r.doc_id: r for r in bpe.token_counts(docs(spark, texts), limit=9).collect()}
    for i, t in enumerate(texts):
        cut = max(k for k in range(len(t) + 1) if size(t[:k]) <= 9)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit, rows[i].cut_bytes) == (len(t.encode()), size(t), size(t) > 9, len(t[:cut].encode()))
    again = docs(spark, ["same", "same", None]).withColumn("doc_id", F.lit(4))
    assert sorted(r.n_tokens for r in bpe.token_counts(again).collect()) == [0, 1, 1] and sorted(len(r.ids) for r in bpe.encode_documents(again).collect()) == [0, 1, 1]


def test_bpe_tables(spark, codec):
    d = docs(spark, [*ODD, None])
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(d)).collect()}
    assert [bytes(got[i].decoded) for i in range(len(ODD))] == [t.encode() for t in ODD] and list(got[len(ODD)].ids) == []
    n = {r.doc_id: r for r in bpe.token_counts(d, limit=3).collect()}
    assert n[7].over_limit and n[len(ODD)].n_tokens == 0 and n[6].n_bytes == len(ODD[6].encode())
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def plain_fingerprint(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    rng = random.Random(2)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(12)]
    texts = [None, "", "one", "One", "a b c", *base, *base[:4], *[b + " z" for b in base[:6]], *["same text of five words"] * 90]
    texts += [" ".join([*base[0].split()[:i], "q", *base[0].split()[i + 1 :]]) for i in range(60)]
    want = [plain_fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bin(want[i] ^ want[j]).count("1") <= 4:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    for few in (64, 1):  # by pairs, and by growing components
        monkeypatch.setattr(simhash, "PAIRS_UP_TO", few)
        got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
        assert [got[i].fp % (1 << 64) for i in range(len(texts))] == want
        assert [got[i].component_id for i in range(len(texts))] == up
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    long = " ".join(str(i % 999) for i in range(150_000))  # more shingles than are held at once
    same = docs(spark, [long, long, "a b", "a b", None]).withColumn("doc_id", F.when(F.col("doc_id") < 4, F.col("doc_id") % 2 + 5))
    rows = simhash.near_duplicates(same).collect()
    assert sorted((r.component_id or 0) for r in rows) == [0, 5, 5, 5, 5] and simhash.AT_ONCE < 149_997
    assert {r.fp % (1 << 64) for r in rows} == {plain_fingerprint(long), plain_fingerprint("a b"), 0}


@pytest.mark.parametrize("third", [False, True])
def test_near_fingerprints_share_an_anchor(third):
    rng = np.random.default_rng(3)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    g = f.copy()
    for i in range(300):
        for b in rng.choice(64, i % 5, replace=False):
            g[i] ^= np.uint64(1) << np.uint64(b)
    near = []
    for x in (f, g):
        s = defaultdict(set)
        for r, k in zip(*simhash.anchors(x, simhash.code(third), 2), strict=True):
            s[int(r)].add(int(k))
        near.append(s)
    assert all(near[0][i] & near[1][i] for i in range(300))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 600)]
    up = {x: x for e in links for x in e}
    for a, b in links * len(up):
        m = min(up[a], up[b])
        if up[a] == up[b] == m:
            continue
        up[a] = up[b] = m
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(up[x] == r for x, r in got.items()) and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_components_join_a_multiple_of_their_links(spark, monkeypatch):
    """Links within a component don't meet its labels once more in every round: what is joined shrinks from round to round."""
    from gleaner.llm import components

    written = []
    read = DataFrameReader.parquet

    def parquet(self, *paths):
        df = read(self, *paths)
        if "/links-" in paths[0]:
            written.append(df.count())
        return df

    monkeypatch.setattr(DataFrameReader, "parquet", parquet)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(1500)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(3000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {r for n, r in got.items() if n <= 1500} == {0} and {r for n, r in got.items() if n >= 2000} == {2000} and len(got) == 1501 + 300
    assert written[0] == len({(min(e), max(e)) for e in links if e[0] != e[1]}) and written[-1] == 0 and sum(written) < 3 * written[0]


@pytest.mark.parametrize("few", [0, 600, 10_000])
def test_components_end_in_one_task(spark, monkeypatch, few):
    """Once few links are left a single round moves all nodes to their ends; how many are few changes no root."""
    from gleaner.llm import components

    written = []
    read = DataFrameReader.parquet

    def parquet(self, *paths):
        df = read(self, *paths)
        if "/links-" in paths[0]:
            written.append(df.count())
        return df

    monkeypatch.setattr(DataFrameReader, "parquet", parquet)
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(6)
    links = [(-i, -i - 1) for i in range(700)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(900)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    forest = components.Forest()
    forest.link(*(np.array(x) for x in zip(*links, strict=True)))
    assert got == {x: forest.root(x) for e in links if e[0] != e[1] for x in e}
    short = next(i for i, n in enumerate(written) if n <= few)  # no further round than the one that ends it
    assert written[-1] == 0 and len(written) <= short + 2


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def plain_windows(rows, size=20):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if seen.setdefault(k, (d, i)) < (d, i):
                gone[i : i + size] = [True] * size
        out[d] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("slice_bytes", [substring.SLICE, 300])
def test_substring(spark, tmp_path, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring, "SLICE", slice_bytes)
    rng = random.Random(5)
    voc = ["w%d" % i for i in range(6)]
    passages = [rng.choices(voc, k=rng.randint(15, 45)) for _ in range(4)]
    texts = []
    for _ in range(60):
        w = sum((rng.choice(passages) if rng.random() < 0.6 else rng.choices(voc, k=rng.randint(0, 30)) for _ in range(rng.randint(0, 4))), [])
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += [None, "", "same " * 400, texts[0]]
    want = plain_windows(list(enumerate(texts)))
    for batches in (5, 1):
        got = {r.doc_id: (r.n_words, r.n_removed, (r.text or "").split()) for r in substring.dedup_corpus(docs(spark, texts).repartition(3), batches).collect()}
        assert got == want
    assert substring.dedup_corpus(docs(spark, [])).count() == 0
    # batch after batch, with compaction, as in one go; the index is opened anew for each
    removed = {}
    for at in range(0, 64, 9):
        part = docs(spark, texts[at : at + 9], at)
        index = substring.FingerprintIndex(spark, f"file://{tmp_path}/ix", 4)
        removed |= {r.doc_id: r.n_removed for r in substring.remove_spans(part, index.repeated(part, docs(spark, texts))).collect()}
    assert removed == {d: n for d, (_, n, _) in want.items()}
    assert index.buckets == 4 and max(index.levels()) == 1 and all(len(index.runs(k)) < 3 for k in index.levels())
    plan = spark.table(index._name(1)).groupBy("bucket").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # history stays in its buckets
    if slice_bytes < substring.BUCKET:
        assert index._slices(index._level_bytes(1)) > 3
    with substring.slices_stay(spark):
        plan = index.merged(docs(spark, texts[:9])).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # the batch is dealt once, slices of both sides meet there
    index.close()


def test_substring_with_colliding_hashes(spark, monkeypatch):
    """Hashes of one byte stand for many windows: verification and digests still tell them apart."""
    rng = random.Random(18)
    phrases = [prose(rng, 8) for _ in range(3)]
    texts = [" ".join([rng.choice(phrases) + " " + prose(rng, rng.randint(1, 12)) + " " + rng.choice(phrases) for _ in range(3)]) for _ in range(90)]
    texts += [texts[i] + " " + prose(rng, 5) for i in range(0, 90, 9)]
    settled = []
    monkeypatch.setattr(substring.FingerprintIndex, "_settled", lambda self, bad, *a, f=substring.FingerprintIndex._settled: settled.append(bad.count()) or f(self, bad, *a))
    got = {r.doc_id: (r.n_words, r.n_removed, (r.text or "").split()) for r in substring.dedup_corpus(docs(spark, texts).repartition(3), 3, tag=1).collect()}
    assert got == plain_windows(list(enumerate(texts))) and sum(settled) > 50


def test_substring_of_odd_rows(spark):
    rng = random.Random(19)
    text = prose(rng, 40)
    rows = [(1, text), (None, text), (None, None), (2, text + " end"), (2, "x " * 5), (2, prose(rng, 30)), (3, "")]
    got = substring.dedup_corpus(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows) and sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None) == [(0, 0), (40, 40)]
    assert [(r.n_words, r.n_removed) for r in got if r.doc_id == 1] == [(40, 0)] and (41, 40) in [(r.n_words, r.n_removed) for r in got if r.doc_id == 2]
    long = " ".join(str(i) for i in range(400_000))
    got = {r.doc_id: r.n_removed for r in substring.dedup_corpus(docs(spark, [long, long + " tail", None])).collect()}
    assert got == {0: 0, 1: 400_000, 2: 0}


def test_statistics():
    rng = random.Random(6)
    for _ in range(400):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 50))]
        at, cover = defaultdict(list), set()
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        for v in at.values():
            cover.update(x for i in v for x in range(i, i + 8) if len(v) > 1)
        assert stats.repeated_words(w) == len(cover)
    assert stats.counts("é# b\n\n é# b\né# b\n*")[0] == [7, 10, 4, 1, 0]
    assert stats.counts("")[0] == [0] * 5


def plain_mcd(x, h, ridge):
    """The mean and covariance of the h rows with the least determinant, by trying all."""
    best = None
    for some in combinations(range(len(x)), h):
        y = x[list(some)]
        c = np.cov(y.T, bias=True) + np.diag(ridge)
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], y.mean(0), c
    return best


def test_determinant_is_the_least():
    rng = np.random.default_rng(15)
    floors = np.array([0.05, 0.05])
    for _ in range(8):
        x = np.concatenate([rng.standard_normal((8, 2)), 6 + rng.standard_normal((4, 2))])
        h = outliers.subset_size(12, 2)
        det, m, c = plain_mcd(x, h, floors**2)
        got = outliers.solve(x, floors)
        assert got[0] == pytest.approx(det, abs=1e-6) and got[1] == pytest.approx(m) and np.linalg.inv(got[2]) == pytest.approx(c)
    t = rng.standard_normal((400_000, 8)) / np.sqrt(rng.chisquare(5, 400_000) / 5)[:, None]
    assert np.quantile((t * t).sum(1), 0.5) == pytest.approx(outliers.reference(8, 0.5), rel=0.02)
    assert np.quantile((t * t).sum(1), 0.999) == pytest.approx(outliers.reference(8, 0.999), rel=0.1)


def test_large_groups_like_small_ones(spark):
    """Chunks and C-steps over the whole against one task; a group of one row, repeats, nulls."""
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.standard_normal((1700, 3)) * [1, 2, 0.5] + [3, 0, 1], 30 + rng.standard_normal((300, 3))])
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", i, v.tolist()) for i, v in enumerate(x[:300])] + [("c", 0, [1.0, 2.0, 3.0])] + [("d", i, [1.0, 2.0, 3.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "gid string, k int, x array<double>").repartition(3)
    floors = [0.05, 0.05, 0.05]
    whole = {(r.gid, r.k): r.d for r in outliers.fit_and_score(df, 3, floors).collect()}
    parts = {(r.gid, r.k): r.d for r in outliers.fit_and_score(df, 3, floors, chunk=256).collect()}
    assert len(whole) == len(rows) == len(parts)
    cut = outliers.reference(3, 0.999)
    assert [whole["a", i] > cut for i in range(2000)] == [parts["a", i] > cut for i in range(2000)] == [i >= 1700 for i in range(2000)]
    assert np.median([abs(parts["a", i] / whole["a", i] - 1) for i in range(2000)]) < 0.1
    assert whole["c", 0] <= cut and all(whole["d", i] <= cut and parts["d", i] <= cut for i in range(500))
    det, m, inv = outliers.solve(x[:300][np.lexsort(x[:300].T)], np.array(floors))
    d = outliers.distances(x[:300], m, inv)
    assert [whole["b", i] for i in range(300)] == pytest.approx((d / np.median(d) * outliers.reference(3, 0.5)).tolist())


def plain_large(x, start, floors, steps=outliers.STEPS):
    """Estimate and scaled distances of one group: C-steps from a start over all rows, exact sums by fractions of the sorted rows, no bins."""
    _, m, inv = start
    h, last = outliers.subset_size(len(x), x.shape[1]), np.inf
    for _ in range(steps):
        d = np.array([(r - m) @ inv @ (r - m) for r in x])
        y = x[np.argsort(d, kind="stable")[:h]]
        c = np.cov(y.T, bias=True) + np.diag(np.square(floors))
        if np.linalg.slogdet(c)[1] > last - 1e-9:
            break
        last, m, inv = np.linalg.slogdet(c)[1], y.mean(0), np.linalg.inv(c)
    return np.array([(r - m) @ inv @ (r - m) for r in x])


def test_large_groups_don_t_depend_on_partitions(spark):
    """Bit by bit the same distances however rows are dealt out; near those of a plain version; copies count each; slices of groups."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.standard_normal((2400, 3)) * [1, 2, 0.5] + [3, 0, 1], 9 + rng.standard_normal((600, 3))])
    x[:300] = x[0]
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", i, (v * 2).tolist()) for i, v in enumerate(x[:1500])]
    floors = [0.05, 0.05, 0.05]
    got = []
    for parts in (1, 5):
        df = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), "gid string, k int, x array<double>").repartition(parts)
        got.append({(r.gid, r.k): r.d for r in outliers.fit_and_score(df, 3, floors, chunk=500).collect()})
    assert got[0] == got[1] and len(got[0]) == len(rows)
    d = plain_large(x, outliers.solve(x[np.lexsort(x.T)], np.array(floors)), np.array(floors))
    d = d / np.median(d) * outliers.reference(3, 0.5)
    ours, cut = np.array([got[0]["a", i] for i in range(3000)]), outliers.reference(3, 0.999)
    assert np.abs(ours / d - 1).max() < 0.05 and ((ours > cut) == (d > cut)).mean() > 0.999


def test_slices_of_groups(spark, monkeypatch):
    rng = np.random.default_rng(22)
    rows = [(f"g{g}", i, v.tolist()) for g in range(5) for i, v in enumerate(rng.standard_normal((120, 2)) * (g + 1))]
    df = spark.createDataFrame(rows, "gid string, k int, x array<double>")
    once = {(r.gid, r.k): r.d for r in outliers.fit_and_score(df, 2, [0.05, 0.05], chunk=50).collect()}
    monkeypatch.setattr(outliers, "GROUPS", 2)
    assert once == {(r.gid, r.k): r.d for r in outliers.fit_and_score(df, 2, [0.05, 0.05], chunk=50).collect()} and len(once) == 600


def test_step_of_bins_is_that_of_rows():
    """Whole numbers in bins against the rows themselves."""
    rng = np.random.default_rng(23)
    x, floors, scale = rng.standard_normal((700, 3)) * 3, np.array([0.05, 0.1, 0.2]), 2.0**20
    m, inv = np.zeros(3), np.eye(3)
    parts = [outliers.binned(outliers.whole_numbers(y, scale), scale, m, inv) for y in np.array_split(x, 7)]
    bins, sums = outliers.fold(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    det, mean, got, mid = outliers.next_estimate(bins, sums, scale, floors)
    d = (x * x).sum(1)
    h = outliers.subset_size(700, 3)
    y = x[np.argsort(d)[:h]]
    c = np.cov(y.T, bias=True) + np.diag(floors**2)
    assert sums[:, 0].sum() == 700 and mid == pytest.approx(np.median(d), rel=0.02)
    assert det == pytest.approx(np.linalg.slogdet(c)[1], abs=0.02) and mean == pytest.approx(y.mean(0), abs=0.02) and np.linalg.inv(got) == pytest.approx(c, abs=0.05)
    exact = outliers.binned(outliers.whole_numbers(x, scale), scale, m, inv)
    assert (exact[0] == bins).all() and outliers.next_estimate(*exact, scale, floors)[0] == det
    assert outliers.median(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 2])) == 2.0 and outliers.median(np.array([1.0, 4.0]), np.array([1, 1])) == 2.5


def plain_rules(rows):
    """{doc_id: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)} word by word and group by group; rows are (doc_id, text, lang, source)."""
    out, vec = {}, {}
    for i, text, lang, source in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        wins = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        many = {w for w, n in Counter(wins).items() if n > 1}
        cover = {j + o for j, w in enumerate(wins) if w in many for o in range(8)}
        base = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)]
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        out[i] = [*base, failed, False]
        if not failed:
            vec[i] = (lang, source)
    return out, vec


def test_quality_rules_like_a_plain_version(spark):
    rng = random.Random(8)
    rows = []
    for i in range(420):
        lang, source = (("en", "web"), ("en", "books"), ("de", "web"), (None, "few"))[0 if i < 200 else 1 if i < 300 else 2 if i < 405 else 3]
        text = prose(rng, rng.randint(30, 160)) + ".\n" + "same line\n" * (i % 3)
        rows.append((i, text if i % 20 else "".join(w + "$# " for w in prose(rng, 60).upper().split()), lang, source))
    rows += [(420, None, "en", "web"), (421, "", "en", "web"), (422, "one two three four five six seven eight " * 9, "en", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.quality_rules(df).collect()}
    want, vec = plain_rules(rows)
    st = {r.doc_id: r.vec for r in stats.text_statistics(df, {}).collect()}
    groups = {}
    for i, g in vec.items():
        groups.setdefault(g, []).append(i)
    k, floors, cut = len(outliers.FEATURES), np.array(list(outliers.FEATURES.values())), outliers.reference(len(outliers.FEATURES), outliers.QUANTILE)
    small = [i for g, ids in groups.items() if len(ids) < outliers.LEAST * k for i in ids]
    for ids in [small, *[v for v in groups.values() if len(v) >= outliers.LEAST * k]]:
        x = np.array([[st[i][stats.RATIOS.index(f)] for f in outliers.FEATURES] for i in ids])
        d = plain_large(x, outliers.solve(x[np.lexsort(x.T)], floors), floors)
        mid = np.median(d)
        for i, v in zip(ids, d / mid * outliers.reference(k, 0.5), strict=True):
            want[i][6] = bool(v <= cut)
    assert {i: [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept] for i, r in got.items()} == want
    assert sum(w[6] for w in want.values()) > 380 and not any(want[i][6] for i in range(0, 300, 20))


def test_quality_rules_and_classifier(spark):
    rng = random.Random(7)
    good = [prose(rng, rng.randint(60, 200)) + "." for _ in range(260)]
    bad = ["".join(w + "$$$ " for w in prose(rng, 80).upper().split()) for _ in range(30)]
    texts = [*good, *bad, None, "", "few words", "the same eight words again and again and " * 30]
    d = docs(spark, texts)
    got = {r.doc_id: r for r in outliers.quality_rules(d).collect()}
    assert len(got) == len(texts) and all(got[i].base_failed and not got[i].kept for i in range(290, 294))
    assert sum(got[i].kept for i in range(260)) >= 258 and not any(got[i].kept for i in range(260, 290))
    assert outliers.quality_rules(docs(spark, [])).count() == 0
    few = outliers.quality_rules(docs(spark, good[:5])).collect()
    assert all(r.kept for r in few)
    odd = docs(spark, [*good[:40], good[0], good[0], "word " * 150_000, None]).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s")).withColumn("doc_id", F.when(F.col("doc_id") < 40, F.col("doc_id")))
    odd = outliers.quality_rules(odd).collect()
    assert len(odd) == 44 and sum(r.kept for r in odd) >= 40 and [r.base_failed for r in odd if r.n_words in (0, 150_000)] == [True, True]
    labels = spark.createDataFrame([(i, int(i < 260)) for i in range(290)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in classifier.quality_scores(d, labels).collect()}
    import zlib

    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    held = [i for i in range(290) if rows[i].held_out]
    assert sum(rows[i].predicted == int(i < 260) for i in held) >= 0.98 * len(held)
    none = classifier.quality_scores(d, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_classifier_like_plain_ridge(spark):
    """Sums over partitions against one system of all rows; folds; held-out order; repeats."""
    rng = np.random.default_rng(17)
    k = len(stats.RATIOS)
    x = rng.standard_normal((900, k))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.7 * rng.standard_normal(900) > 0.4).astype(float)
    train = spark.createDataFrame([(v.tolist(), float(t), i % classifier.FOLDS) for i, (v, t) in enumerate(zip(x, y, strict=True))], "vec array<double>, y double, fold int")
    model = classifier.fit(train.repartition(5))
    z = classifier.fourier(x, x.mean(0), x.std(0))
    size = classifier.COSINES + 1
    plain = lambda i: np.linalg.solve(z[i].T @ z[i] + classifier.RIDGE * len(z[i]) / size * np.eye(size), z[i].T @ y[i])
    assert model.raw(x) == pytest.approx(z @ plain(np.arange(900)), abs=1e-5)
    fold = np.arange(900) % classifier.FOLDS
    raw = np.array([z[i] @ plain(np.flatnonzero(fold != fold[i])) for i in range(900)])
    at = np.clip(((raw - classifier.LOW) / (classifier.HIGH - classifier.LOW) * classifier.BINS).astype(int), 0, classifier.BINS - 1)
    u, inv = np.unique(at, return_inverse=True)
    knots, values = classifier.calibration(classifier.LOW + (u + 0.5) * (classifier.HIGH - classifier.LOW) / classifier.BINS, np.bincount(inv, y), np.bincount(inv).astype(float))
    new = rng.standard_normal((3000, k))
    got = model.score(new)
    assert got == pytest.approx(np.interp(model.raw(new), knots, values), abs=0.02) and (np.diff(values) > 0).all()
    order = np.argsort(model.raw(new))
    assert (np.diff(got[order]) >= 0).all() and len(np.unique(got)) > 2900
    truth = (new[:, 0] + 0.5 * new[:, 1] ** 2 + 0.7 * rng.standard_normal(3000) > 0.4).astype(float)
    for lo, hi in ((0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)):  # what is said comes about
        some = (got >= lo) & (got < hi)
        assert abs(truth[some].mean() - got[some].mean()) < 0.1
    same = docs(spark, ["a b c"] * 4).withColumn("doc_id", F.lit(6))
    labels = spark.createDataFrame([(6, 1)], "doc_id long, quality int")
    assert len({(r.score, r.predicted) for r in classifier.quality_scores(same, labels).collect()}) == 1
    assert classifier.quality_scores(docs(spark, []), labels).count() == 0


def test_isotonic():
    assert classifier.pool_adjacent(np.array([1.0, 0, 3, 2]), np.array([1.0, 1, 3, 4])).tolist() == [0.5, 0.5, 5 / 7, 5 / 7]


def test_mixing(spark):
    rng = random.Random(8)
    names = ["a", "b", None, "c", "d"]
    texts = [None if i == 5 else "w " * rng.randint(0, 40) for i in range(300)]
    d = docs(spark, texts, source=lambda i: names[0] if i % 3 else names[i % 5])
    rows = mixing.plan_mix(d).collect()
    again = mixing.plan_mix(d.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    src = {i: (names[0] if i % 3 else names[i % 5]) for i in range(300)}
    total = defaultdict(int)
    for i, s in src.items():
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + [None]
    w, target, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}, 1.5 * sum(total.values())
    free = set(order)
    while free:  # share by weight, stop at twice the size, share the excess again
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * total[s]}
        target |= {s: 2 * total[s] if s in full else share[s] for s in (full or free)}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == total[src[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[src[r.doc_id]])
        assert (r.position is None) == (r.taken == 0) == (r["rank"] is None) and (r.again is None) == (r.rank_again is None) == (r.taken <= r["size"])
        taken[src[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    ranks = sorted((k, p) for r in rows for k, p in ((r["rank"], r.position), (r.rank_again, r.again)) if k is not None)
    assert [k for k, _ in ranks] == list(range(1, len(ranks) + 1)) and [p for _, p in ranks] == sorted(p for _, p in ranks)
    kinds = {s: mixing.SCHEDULES[k % 3] for k, s in enumerate(order)}

    def demand(schedule, t):  # by small steps
        x, y = zip(*schedule, strict=True)
        grid = np.linspace(0, 1, 20_001)
        w = np.interp(grid, x, y)
        whole = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)]
        return np.interp(t, grid, whole / whole[-1])

    starts = defaultdict(int)
    for r in sorted((r for r in rows if r["size"]), key=lambda r: (order.index(src[r.doc_id]), hashlib.md5(str(r.doc_id).encode()).hexdigest())):
        s = src[r.doc_id]
        if r.position is not None:
            grid = np.linspace(0, 1, 4001)
            t = np.interp(starts[s] / round(target[s]), demand(kinds[s], grid), grid)
            assert r.position == pytest.approx(sum(round(target[x]) * demand(kinds[x], t) for x in order), abs=0.002 * sum(target.values()))
        starts[s] += r["size"]
    mix = mixing.mix_documents(d).collect()
    assert [r.doc_id for r in mix] == [i for _, i in sorted((k, r.doc_id) for r in rows for k in (r["rank"], r.rank_again) if k is not None)]
    assert sum(len(r.text.split()) for r in mix) == sum(taken.values())
    same = docs(spark, ["w " * 20] * 4 + ["x " * 20] * 3 + [None, ""], source=lambda i: "ab"[i % 2]).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 2))
    plan = mixing.plan_mix(same).collect()
    assert len(plan) == 9 and sum(r.taken for r in plan) == sum(len(r.text.split()) for r in mixing.mix_documents(same).collect())
    assert mixing.plan_mix(docs(spark, [])).count() == 0


def test_digest_of_ids(spark, codec):
    row = bpe.encode_documents(docs(spark, ["hello  world"])).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).head()[0]
    assert row == hashlib.sha256(" ".join(map(str, codec.encode("hello  world"))).encode()).hexdigest()


def test_substring_work_of_a_batch(spark, tmp_path):
    """A batch is passed on once beside a level, words are found and numbered for many texts at once, and only what may repeat is put in order."""
    import numpy as np
    import xxhash

    rng = random.Random(20)
    texts = [b"", b" \t", b"a", b"a\x0bb\x0cc \n", "é x \x00y\x1fz".encode(), b"a b " * 30]
    words, many = substring._split(texts)
    assert words.to_pylist() == [w for t in texts for w in t.split()] and many.tolist() == [len(t.split()) for t in texts]
    coded = words.dictionary_encode().dictionary
    assert substring._hashes(coded).tolist() == [xxhash.xxh3_64_intdigest(w) for w in coded.to_pylist()]
    for earlier in (None, [(rng.randrange(6), rng.randrange(4), d, s) for d in range(9) for s in range(9)]):
        of = lambda rows: type("W", (), dict(zip(("mini", "tag", "doc", "start"), (np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.uint64, np.int64, np.int64))))))  # noqa: B023, B905, E731
        rows = [(rng.randrange(40), rng.randrange(4), d, s) for d in range(9, 18) for s in range(9)]
        i, doc, start, again = substring._found(of(rows), of(earlier) if earlier else None)
        first = {}
        for m, t, d, s in earlier or rows:
            first[m, t] = min(first.get((m, t), (d, s)), (d, s))
        want = {k: first[r[:2]] for k, r in enumerate(rows) if first.get(r[:2], r[2:]) != r[2:]}
        assert dict(zip(i.tolist(), zip(doc.tolist(), start.tolist()))) == want and sorted(i) == np.flatnonzero(again).tolist()  # noqa: B905
    part = docs(spark, [prose(rng, 60) for _ in range(9)])
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/ix", 4)
    index.candidates(part)
    with substring.slices_stay(spark):
        plan = index.merged(part)._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "FlatMapCoGroupsInArrow" in plan and "FlatMapGroupsInArrow" not in plan
