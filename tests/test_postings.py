"""Postings at size: what is staged and shuffled of them."""


from gleaner import staging
from gleaner.operators import postings, rank
from gleaner.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_scores_from_postings_that_are_not_staged(spark):
    """Places are read where they are built: no table of them is written, and the scores are those of the texts."""
    before = len(staging._made)
    got = sorted(map(tuple, QUERIES["bm25_from_postings"](spark, SF).collect()))
    assert not [path for _, path in staging._made[before:] if path.endswith("-postings")]
    assert got and got == sorted(map(tuple, QUERIES["bm25_scores"](spark, SF).collect()))


def test_lists_of_matches_from_postings(spark, monkeypatch):
    """Rows of a paragraph next to each other are not shuffled, others once, whatever is gathered at a time; occurrences may overlap."""
    texts = ["aaaaa aaaa", "", "ab", "the theme thé", "漢字漢字漢字", "THEM them", "xyz" * 400]
    p = spark.createDataFrame(list(enumerate(texts)), "para_id long, text string").coalesce(1)
    words = ["aaa", "aaaa", "the", "them", "漢字漢", "absent", "xyzx"]
    want = {(i, w): sum(t.lower().startswith(w, k) for k in range(len(t))) for i, t in enumerate(texts) for w in words}
    for gathered in (50_000, 2):
        monkeypatch.setattr(postings, "GATHERED", gathered)
        for together in (True, False):
            found = postings.lists(postings.build(p), words, 10, together)
            assert (" Exchange " in found._jdf.queryExecution().executedPlan().toString()) is not together
            rows = found.collect()
            assert {(r.para_id, words[c - 10]): tf for r in rows for c, tf in zip(r.codes, r.tfs, strict=True)} == {k: n for k, n in want.items() if n}
            if together:
                assert [(r.para_id, r.n_tri) for r in rows] == [(i, max(0, len(t) - 2)) for i, t in enumerate(texts)]


def test_first_from_postings_that_are_not_staged(spark):
    before = len(staging._made)
    got = sorted(map(tuple, QUERIES["text_topk_from_postings"](spark, SF).select("query_id", "para_id", "rank").collect()))
    assert not [path for _, path in staging._made[before:] if path.endswith(("-postings", "-word-blocks"))]
    assert got and got == sorted(map(tuple, QUERIES["text_search_topk"](spark, SF).select("query_id", "para_id", "rank").collect()))
