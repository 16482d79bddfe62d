"""Context-tree weighting, importance resampling and the filter audit against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from gleaner.llm import audit, ctw, queries, resampling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, train string, rid string, key string, part string, A string"
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "A", "a b c", "É é 漢字 😀", "x" * 3000, "Aa| #b", " x\x1cy", "the the the"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "c", "c", "c", "c", "c") for i, t, lang in rows], DOCS)


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(40)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


# --- context-tree weighting ---


def is_train(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def plain_tree(texts, depth):
    """Zeros and ones of each (context, bits so far)."""
    seen = defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\xff" * depth + t.encode().lower() + b"\xff"
        for at in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8):
                    seen[data[at - d : at], format(data[at], "08b")[:k]][data[at] >> (7 - k) & 1] += 1
    return seen


def plain_log_p(seen, depth):
    kt = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    children = defaultdict(list)
    for c, bits in seen:
        if c:
            children[c[1:], bits].append((c, bits))

    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*seen[node])
            memo[node] = own if len(node[0]) == depth else np.logaddexp(own, sum(map(weighted, children[node]))) - math.log(2)
        return memo[node]

    def chance(context, bits, d):
        """Of a one, at the node of the last d bytes of context."""
        node = context[depth - d :], bits
        z, o = seen.get(node, (0, 0))
        own = (o + 0.5) / (z + o + 1)
        if d == depth or (context[depth - d - 1 :], bits) not in seen:
            return own
        w = math.exp(kt(z, o) - math.log(2) - weighted(node))
        return w * own + (1 - w) * chance(context, bits, d + 1)

    def log_p(text):
        data, total = b"\xff" * depth + text.encode().lower() + b"\xff", 0.0
        for at in range(depth, len(data)):
            b = format(data[at], "08b")
            for k in range(8):
                one = chance(data[at - depth : at], b[:k], 0)
                total += math.log10(one if b[k] == "1" else 1 - one)
        return total

    return log_p, weighted


@pytest.fixture(scope="module")
def corpus():
    texts = [*ODD, *some_texts(25, 3), "a b c"]
    return [(None if i == 7 else 3 if i == 9 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sent", [ctw.SENT, 0])
def test_lm_scores(spark, corpus, sent):
    got = ctw.score_texts(docs(spark, [(i, t, "en") for i, t in corpus]), sent=sent).collect()
    train = [t or "" for i, t in corpus if is_train(i)]
    log_p, _ = plain_log_p(plain_tree(train, ctw.DEPTH), ctw.DEPTH)
    tokens = lambda t: [*t.encode().lower().split(), None]
    c = Counter(w for t in train for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = []
    for i, t in corpus:
        w = tokens(t or "")
        want.append((-1 if i is None else i, not is_train(i), len(w), sum(x in c for x in w), total, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), log_p(t or "")))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for r in got:
        n = len((dict(corpus[:9]).get(r.doc_id, None) or "").encode())
        assert r.bits_per_byte > 0 and (r.doc_id not in range(3) or r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (n + 1)))


def test_tree_is_a_distribution():
    """At any context the chances of all 256 bytes add up to one, and block probabilities are those of the sequential rule."""
    texts = some_texts(6, 1)
    keys = np.concatenate([k for k, _ in ctw.windows(texts)])
    seen, n = ctw.distinct(keys)
    for prefix in (int(seen[0] >> 8), int(seen[-1] >> 8), 12345):
        every = np.unique(np.r_[seen, prefix << 8 | np.arange(256)])
        times = np.where(np.isin(every, seen), 0, 0)
        times[np.isin(every, seen)] = n
        leaves, places = ctw.Nodes.of_strings(every, times)
        levels = ctw.climb(leaves, ctw.DEPTH)
        a, b = ctw.descend(levels, np.zeros(len(levels[-1].key)), np.ones(len(levels[-1].key)))
        one = a + b * leaves.chance()
        byte = every & 255
        p = np.prod([np.where(byte >> (7 - k) & 1, one[places[k]], 1 - one[places[k]]) for k in range(8)], axis=0)
        assert p[(every >> 8) == prefix].sum() == pytest.approx(1, abs=1e-9)
    tree = plain_tree(texts, ctw.DEPTH)
    _, weighted = plain_log_p(tree, ctw.DEPTH)
    want = {int("1" + bits, 2): weighted((b"", bits)) for c, bits in list(tree) if c == b""}
    leaves, _ = ctw.Nodes.of_strings(seen, n)
    root = ctw.climb(leaves, ctw.DEPTH)[-1]
    assert dict(zip(root.key.tolist(), root.weighted.tolist(), strict=True)) == pytest.approx(want)


def test_kt_and_long_texts(monkeypatch):
    z, o = np.array([0, 0, 1, 5, 1000, 10**9], float), np.array([0, 1, 1, 2, 3, 10**8], float)
    assert ctw.kt(z, o).tolist() == pytest.approx([math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(z, o, strict=True)], rel=1e-9, abs=1e-12)
    text = "ab cde " * 50
    whole = [(k.tolist(), w.tolist()) for k, w in ctw.windows(["x", text, ""])]
    monkeypatch.setattr(ctw, "BYTES", 16)
    cut = [(k.tolist(), w.tolist()) for k, w in ctw.windows(["x", text, ""])]
    assert len(cut) > 10 and sum((c[0] for c in cut), []) == whole[0][0] and sum((c[1] for c in cut), []) == whole[0][1]
    count = lambda b: Counter({(w, r): n for x in b for w, rs, ns in zip(*(x.column(c).to_pylist() for c in ("word", "rids", "counts")), strict=True) for r, n in zip(rs, ns, strict=True)})
    rids, learn = np.array([5, 9, 7]), np.array([True, False, True])
    one = count(ctw._words(["x", text, ""], rids, learn))
    monkeypatch.setattr(ctw, "WORD_BYTES", 10)
    pieces = list(ctw._words(["x", text, ""], rids, learn))
    many = Counter()
    for x in pieces:
        many.update(count([x]))
    assert many == one == {(b"x", 5): 1, (b" ", 5): 1, (b" ", 9): 1, (b" ", 7): 1, (b"ab", 9): 50, (b"cde", 9): 50}


def test_model_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    values = rng.random(len(keys))
    at = rng.integers(0, len(keys), 20_000)
    assert np.array_equal(ctw.Model(keys, values)(keys[at]), values[at])
    assert ctw.Model(keys[:0], values[:0])(keys[:0]).tolist() == []


def test_a_model_in_parts(spark):
    """A model too large to be sent whole: each part gives what its strings do, others add nothing, and the sum is that of the whole."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    values = rng.random(len(keys))
    parts = [ctw.Model(keys[k::3], values[k::3])(keys) for k in range(3)]
    assert np.array_equal(sum(parts), values) and all(np.count_nonzero(p) == len(keys[k::3]) for k, p in enumerate(parts))
    corpus = docs(spark, [(i, f"Some words {i % 7} in text {i}" * (i % 5), "en") for i in range(60)])
    whole, apart = ({r.doc_id: (r.n_known, r.base_score, r.score) for r in ctw.score_texts(corpus, sent=sent).collect()} for sent in (ctw.SENT, 0))
    assert len(whole) == 60 and all(apart[i] == pytest.approx(x, rel=1e-12) for i, x in whole.items())


def test_lm_of_empty_and_untrained_tables(spark):
    assert ctw.score_texts(docs(spark, [])).count() == 0
    held = next(i for i in range(100) if not is_train(i))
    r = ctw.score_texts(docs(spark, [(held, "ab", "en")])).first()
    assert r.held_out and (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0.0) and r.score == pytest.approx(24 * math.log10(0.5))


def test_lm_query(spark):
    got = queries.op11_lm_scoring(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and np.isfinite(got.score).all() and (got.score < 0).all()


# --- importance resampling ---


def plain_resample(rows, target, percent=10, min_words=20, longest=1):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in xs for f in feats(x)[1]) for xs in ([x for _, x in rows], target))
    a, b = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[f] + 1) * (a + 10000) / ((s[f] + 1) * (b + 10000))))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        w, f = feats(text)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w), i])
    order = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[6]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "longest", "range_rows"), [(10, 1, 100_000), (50, 2, 7), (100, 1, 1)])
def test_resampling(spark, percent, longest, range_rows, monkeypatch):
    texts = [*ODD, *some_texts(150, 5), *some_texts(150, 5)]
    rows = [(None if i % 50 == 49 else i // 2 * 2, t) for i, t in enumerate(texts)]  # repeated and null ids
    target = [None, "", *some_texts(8, 6)]
    frame = spark.createDataFrame([(t, "c") for t in target], "text string, doc_id string")
    monkeypatch.setattr(resampling, "REMEMBERED", 20)
    scored = resampling.score_documents(docs(spark, [(i, t, "en") for i, t in rows]).repartition(5), frame, longest)
    ranks = resampling.draw(scored, percent, range_rows=range_rows)
    got = scored.join(ranks, "rid", "left").select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = plain_resample(rows, target, percent, longest=longest)
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, (r[:4] for r in want)))
    key = lambda r: (r[4], r[0] or -1, r[3])
    assert sorted((key(r) for r in got if r[4])) == sorted(key(r) for r in want if r[4])  # rows with one id and score may swap ranks


def test_tournament():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), i, j) for j in range(rng.randint(0, 9))) for i in range(k)]
        assert list(resampling.Tournament([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs(spark, []), none).count() == 0
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 25)), "en") for i in range(20)]
    got = resampling.resample(docs(spark, rows), none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def test_resampling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert sorted((tuple(r) for r in queries.op12_importance_resampling(spark, SF).collect()), key=str) == plain_resample(rows, target)


# --- filter audit ---


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = defaultdict(list)
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = "A" * (len(w) < 200) + "B" * (2 * len(set(w)) < len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails[lang or ""].append((bad + "E" * (i is not None and least[t] < i), i in good, i in toxic))
    out = set()
    for part, v in fails.items():
        shapley, lines = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                here = [x for x in v if not set(order[:k]) & set(x[0])]
                gone = [x for x in here if f in x[0]]
                shapley[f] += len(gone)
                lines.append((f, order, k + 1, len(here) - len(gone), len(gone), sum(f in x[0] for x in v) - len(gone), sum(x[0] == f for x in v), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out |= {(part, *x[1:], shapley[x[0]]) for x in lines}
    return out


def test_audit(spark):
    rng = random.Random(4)
    texts = [*ODD, *(" ".join(rng.choices(["Ab", "c", "d#", "e", "f%", "GH", *(f"w{i}" for i in range(400))], k=rng.choice((3, 150, 250, 400)))) for _ in range(60))]
    texts += rng.choices(texts, k=30)
    rows = [(None if i % 17 == 16 else i - i % 2, t, rng.choice(["en", "de", "", None, "only"]) if i else "one") for i, t in enumerate(texts)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in [None, *range(0, 90, 2), *range(0, 20, 2)]]
    frame = spark.createDataFrame([(*x, "c") for x in labels], "doc_id long, quality int, toxic int, text string")
    good = [(i, q, t) for i, q, t in labels if i is not None]
    got = [tuple(r) for r in audit.audit(docs(spark, rows), frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, good)
    assert audit.audit(docs(spark, []), frame).count() == 0


def test_audit_shares_states(spark, monkeypatch):
    """32 states less the last one are entered once each, whatever the number of orders."""
    entered = []
    edges = audit._edges
    monkeypatch.setattr(audit, "_edges", lambda s, state, f: entered.append(state) or edges(s, state, f))
    v = spark.createDataFrame([("p", True, False, True, False, True, True, False)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    audit.walk(v).collect()
    assert len(entered) == len(set(entered)) == 31 and max(map(len, entered)) == 4


def test_audit_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert {tuple(r) for r in queries.op13_filter_audit(spark, SF).collect()} == plain_audit(rows, labels)
