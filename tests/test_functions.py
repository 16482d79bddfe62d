"""Paragraphs, frontmatter, tags and other column functions, on small inputs with known results."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from gleaner.functions import embedding, markup, text
from gleaner.operators.segment import paragraphs_of, split_paragraphs
from gleaner.sources import files
from gleaner.sources.convert import html_text, html_texts

SPLIT = [
    ("a\nb\n\nc\n", [(1, 2, "a\nb", ""), (4, 4, "c", "")]),
    ("a\n\n\n\nb", [(1, 1, "a", ""), (5, 5, "b", "")]),
    ("a", [(1, 1, "a", "")]),
    ("a\r\nb\r\n\r\nc", [(1, 2, "a\nb", ""), (4, 4, "c", "")]),
    ("a\n \t\nb", [(1, 1, "a", ""), (3, 3, "b", "")]),
    ("a\n\u3000\nb", [(1, 1, "a", ""), (3, 3, "b", "")]),
    ("", []),
    ("# Auth\n\nintro text\n\n## Errors\n\nhandling text", [(1, 1, "# Auth", "Auth"), (3, 3, "intro text", "Auth"), (5, 5, "## Errors", "Auth > Errors"), (7, 7, "handling text", "Auth > Errors")]),
    ("# A\n\n### B", [(1, 1, "# A", "A"), (3, 3, "### B", "A > B")]),
    ("# A\n### B\n### D", [(1, 3, "# A\n### B\n### D", "A > B > D")]),
    ("#x\n\n #y\n\n####### z\n\n#\tq\n\n# ", [(1, 1, "#x", ""), (3, 3, " #y", ""), (5, 5, "####### z", ""), (7, 7, "#\tq", ""), (9, 9, "# ", "")]),
]


def rows(spark, cases):
    return spark.createDataFrame(list(enumerate(cases)), "id int, content string")


def test_split(spark):
    got = {}
    for r in split_paragraphs(rows(spark, [c for c, _ in SPLIT])).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.start_line, r.end_line, r.text, r.heading))
        assert r.seq == len(got[r.id]) - 1
    for i, (content, want) in enumerate(SPLIT):
        assert got.get(i, []) == want, content
        assert paragraphs_of(content) == want


def test_frontmatter_is_hidden(spark):
    got = split_paragraphs(rows(spark, ["---\ntags: [a]\n---\nbody\n\nmore", "---\nnot closed"])).orderBy("id", "seq").collect()
    assert [(r.id, r.seq, r.start_line, r.text) for r in got] == [(0, 0, 4, "body"), (0, 1, 6, "more"), (1, 0, 1, "---\nnot closed")]


def test_tags(spark):
    cases = {
        "---\ntags: [Design, API]\n---\nbody": ["design", "api"],
        "---\ntags: design, api\n---\nbody": ["design", "api"],
        "---\ntags:\n  - a\n  - B\n---\nbody": ["a", "b"],
        "---\ntags:\n  - a\nx: 1\n  - B\n---\nbody": ["a"],
        "---\ntags: [\"a\", 'b']\n---\n": ["a", "b"],
        "---\ntags: [a, A, a]\n---\n": ["a"],
        "---\r\ntags: [a]\r\n---\r\nbody": ["a"],
        "body": [], "---\ntags: [a]\nbody": [], "---\ntitle: x\n---\n": [], "---\ntags: []\n---\n": [], "---\ntags:\nx: y\n---\n": [],
        "---\n---\n": [], "": [],
    }
    got = rows(spark, list(cases)).select("id", markup.parse_tags(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == list(cases.values())


def test_auto_tags(spark):
    cases = {"docs/design/foo.pdf": ["docs", "design", "pdf"], "README.md": ["md"], "Docs/API.md": ["docs", "md"], "noext": [], ".hidden": [], "a/b.": ["a"]}
    got = rows(spark, list(cases)).select("id", markup.auto_tags(F.col("content")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == list(cases.values())


def test_text_functions(spark):
    one = lambda c, s: spark.createDataFrame([(s,)], "x string").select(c(F.col("x"))).head()[0]
    assert one(text.fts_query, "parse config") == '"parse" OR "config"'
    assert one(text.fts_query, 'say "hi"') == '"say" OR """hi"""'
    assert one(text.fts_query, " \u3000") == ""
    assert one(text.snippet, " a\n\u3000 b ") == "a b"
    assert one(text.snippet, "é" * 121) == "é" * 120 + "…"
    assert one(lambda c: markup.with_frontmatter(c, F.array(F.lit("a"), F.lit("b"))), "t") == "---\ntags: [a, b]\n---\nt"
    assert [one(text.is_absolute_key, k) for k in ("/x", "C:/x", "x/y")] == [True, True, False]


def test_embedding(spark):
    v = embedding.hash_embedder(["aé", ""], 4)
    assert v.tolist() == [[97 % 13, 233 % 13, 0, 0], [0, 0, 0, 0]]
    got = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(embedding.l2_normalize(F.col("v"))).collect()
    assert [round(x, 6) for x in got[0][0]] == [0.6, 0.8] and got[1][0] == [0, 0]


class PlainText(HTMLParser):
    """What the parser of the standard library takes for text, a space for each tag, comment and declaration."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], False

    def handle_starttag(self, tag, attrs):
        self.out.append(" ")
        self.hidden = tag in ("script", "style")

    def handle_endtag(self, tag):
        self.out.append(" ")
        self.hidden = False

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_pi = unknown_decl = handle_comment


def test_html_like_the_standard_parser():
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<a href='x>y'>", '<b title="1 > 2" c=d>', "<br/>", "text ", "ä<", " < 3 ", "<!-- a > b -- c -->", "<!DOCTYPE html>", "&amp;", "&lt;b&gt;", "&eacute;", "&#65;", "&#x1F600;", "&nbsp;", "&ampx", "&nothing;", "& ", "\n\t ", "<script>if (a<b) '</p>' </script>", "<STYLE>p > a {}</STYLE >", "<?php 1 ?>", "<hr\n>"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) + " " * rng.randint(0, 1) for _ in range(rng.randint(0, 14))) + "<end>"
        plain = PlainText()
        plain.feed(page)
        plain.close()
        want = re.sub(r"[ \t\n\f\r]+", " ", "".join(plain.out)).strip(" ")
        assert html_text(page) == want, page


def test_html_odd_pages():
    for page, want in (("", ""), ("a", "a"), ("a<", "a<"), ("a</", "a"), ("a<b", "a"), ("a<!--x", "a"), ("a<script>x", "a"), ("<title>x<i>y</i></title>z", "x<i>y</i> z"), ('<a b="c>d', ""), ("<a =>x", "x"), ("1<2", "1<2"), ("<script></scripty></script>x", "x"), ("&amp;lt;", "&lt;"), ("&am<b>p;", "&am p;")):
        assert html_text(page) == want, page


@pytest.mark.parametrize("bit", ["<", "<a", "<a ", "<!--", "<!", "</", "<script>", "<script", "<title>", '<a b="', "<a b=' ", "<a =", "= ", "&", "&#", "&#1", "<a>", "<?", "<title></titl", '="'])
def test_html_is_linear(bit):
    def seconds(n):
        best = 9e9
        for _ in range(3):
            t = time.perf_counter()
            html_text("<a " * (bit in ("= ", '="')) + bit * n)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(160_000) < 4 + 30 * seconds(20_000) and seconds(160_000) < 5


def test_html_column_and_converter(spark, tmp_path):
    df = spark.createDataFrame([(1, "<p>a&nbsp;b</p>"), (2, None), (3, "")], "k int, html string")
    assert {r.k: r.t for r in df.select("k", html_texts(F.col("html")).alias("t")).collect()} == {1: "a b", 2: "", 3: ""}
    at = tmp_path / "x.html"
    at.write_bytes(b"<h1>T</h1>\xff<p>b")
    assert files.convert(["builtin:html"], str(at)) == ("T � b", None)
    assert files.convert(["builtin:html"], str(tmp_path / "none"))[0] is None


def test_block_is_cut_as_lines_are(spark):
    """The block alone gives what all lines of the text give."""
    rng = random.Random(6)
    parts = ["---", " ---\t", "---\r", "\u2003---", "--- x", "----", "tags: [a, b]", "tags:", "- c", " - d", "", "  ", "text", "\x85---", "é"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(6000)] + ["---\n" + "x\n" * n + e for n in (0, 1, 200_000) for e in ("", "---", "---\n", " --- \r\ny")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    whole = text.let(text.lines(F.col("t")), markup._closing)
    assert df.filter(~markup.frontmatter_lines(F.col("t")).eqNullSafe(whole)).count() == 0
    assert df.filter(markup.frontmatter_lines(F.col("t")) > 0).count() > 100
    assert df.filter((markup.frontmatter_lines(F.col("t")) == 0) & (F.size(markup.parse_tags(F.col("t"))) > 0)).count() == 0
    tagged = df.filter(F.size(markup.parse_tags(F.col("t"))) > 0)
    assert tagged.count() > 20 and tagged.filter(~markup.parse_tags(F.concat("t", F.lit("\nmore\n"))).eqNullSafe(markup.parse_tags(F.col("t")))).count() == 0
