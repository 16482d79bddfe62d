"""Near duplicates by resemblance: no link at 0.8 is lost, whatever the fingerprints; groups just under it are decided exactly."""

import random
from itertools import combinations

import numpy as np
import pytest

from gleaner.llm import resemblance as r


def brute_force(texts):
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for w in words]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(texts))]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in r.near_duplicates(docs).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("rounds", [(2, None), (1, None)])
def test_pairs_at_the_limit(spark, monkeypatch, rounds):
    """Pairs that share 57 of 71 shingles (0.803) are linked, those that share 56 of 72 are not: bits of fingerprints decide nothing."""
    monkeypatch.setattr(r, "ROUNDS", rounds)
    rng = random.Random(7)
    texts = []
    for k in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(76)]
        cut = 7 + k % 2
        texts += [" ".join(w[:68]), " ".join(w[cut : cut + 68])]
    want = [2 * (i // 2) if (i // 2) % 2 == 0 else i for i in range(240)]
    assert brute_force(texts) == want == found(spark, texts)


def test_loose_group(spark):
    """Copies of one text with some words changed, so that some pairs are just over 0.8 and most are under it."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(w))
    texts += ["", " ", "a b", "a b", texts[0]]
    want = brute_force(texts)
    assert found(spark, texts) == want and 2 < len(set(want)) < 150


def test_parity_never_excludes_a_near_pair():
    rng = np.random.default_rng(1)
    excluded = 0
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        change = rng.random(len(a)) < rng.choice([0.05, 0.1, 0.12, 0.3])
        b = np.unique(np.where(change, rng.integers(0, 1 << 63, len(a)).astype(np.uint64), a))
        x, y = (np.frombuffer(r.parity(s), np.uint64)[None] for s in (a, b))
        allowed = bool(r.parity_allows(np.array([len(a)]), x, np.array([len(b)]), y)[0])
        assert allowed or not r.near(a, b)
        excluded += not allowed
    assert excluded > 50


def test_round_trip_in_one_pass(spark):
    from gleaner.llm import bpe

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "a  b", "é漢字 it's", "x" * 3000])] + [(None, "again"), (None, "again")], "doc_id long, text string")
    rows = lambda df: sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in df.collect())
    assert rows(bpe.round_trip_documents(docs)) == rows(bpe.decode_documents(bpe.encode_documents(docs)))
