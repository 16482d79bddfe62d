"""Archives, main text and nearest neighbours against plain versions."""

import gzip
import hashlib
import random
import re
import time
from datetime import UTC, datetime

import numpy as np
import pytest

from gleaner.llm import ann, pages, warc
from gleaner.llm.common import new_path

PAGES = "page_id long, url string, html string, digest string, rank int"


def test_archives(spark):
    long = "ä" * 600
    rows = [(1, "http://a/x", long), (2, None, long), (3, "http://b/y\r\nX: z", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (3, "again", long), (7, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" + "y" * 1000), (8, "u", "\r\n\r\n" * 300)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGES)
    got = sorted(warc.round_trip(df).collect(), key=str)
    assert len(got) == len(rows)
    for i, _, html in rows:
        body = (html or "").encode()
        mine = [r for r in got if r.page_id == i and r.payload_digest == hashlib.sha1(body).hexdigest()]
        assert mine and all(r.payload_bytes == len(body) for r in mine)
        kind = ("revisit", 3) if html == long and i in (1, 2) else ("response", None)
        assert {(r.record_type, r.refers_to) for r in mine} == {kind}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_archive_bytes(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _archive_bytes(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _archive_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame([(1, "http://a/", "p" * 1000), (2, "http://b/", "p" * 1000)], "page_id long, url string, html string"), path)
    data = b"".join(gzip.open(f).read() for f in sorted((tmp_path / "w").glob("*.gz")))
    assert data.count(b"p" * 1000) == 1 and data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    ids = [bytes(x) for x in re.findall(rb"WARC-Record-ID: (<urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}>)", data)]
    assert len(set(ids)) == 2 and re.search(rb"WARC-Refers-To: (\S+)", data)[1] in ids
    date = datetime.strptime(re.search(rb"WARC-Date: (\S+)", data)[1].decode(), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    assert abs((datetime.now(UTC) - date).total_seconds()) < 600
    assert new_path(spark, "x") != new_path(spark, "x")


def test_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for bits in (1 << 27, 20):
        monkeypatch.setattr(pages, "BITS", bits)
        for _ in range(500):
            a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
            d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
            got = sorted(pages.shared_lines(a, b))
            rest = iter(b)
            assert len(got) == d[-1][-1] and all(any(x == a[i] for x in rest) for i in got)


def test_main_text(spark):
    art = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp;amp; x</h1><p><b>one\n two<br><p>three &copy</article><footer>f</footer>"
    bare = lambda n, x: f"<body><div>Welcome to the site</div><h1>Head {n}</h1><p>{x}</p><div id='comments'><p>nice</p></div><form>q</form><p>All rights</p></body>"
    rows = [(1, "http://h/a/1", art), (2, "http://h/a/2", art), (3, "http://k/a/1", bare(1, "text one")), (4, "http://k/a/2", bare(2, "text two")), (5, "http://z/only", bare(3, "alone")), (6, None, None), (7, "http://[bad", "plain < text"), (8, "http://q/1", bare(4, "copy")), (9, "http://q/2", bare(4, "copy")), (4, "http://k/a/2", bare(2, "text two"))]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], PAGES)
    out = pages.main_text(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert got[1] == got[2] == "T &amp; x\none two\nthree ©"
    assert got[3] == "Head 1\ntext one" and got[4] == "Head 2\ntext two"
    assert got[5] == "Welcome to the site\nHead 3\nalone\nAll rights" and got[6] == "" and got[7] == "plain < text"
    assert got[8] == got[9] == "Welcome to the site\nHead 4\ncopy\nAll rights"
    assert pages.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_lines_beside_an_article(spark):
    page = lambda n: f"<body><p>All of our site</p><p>Intro {n}</p><article><p>Shared text</p><p>own {n}</p></article><p>After {n}</p><p>All rights</p></body>"
    rows = [(n, f"http://h/{n}", page(n)) for n in (1, 2, 3)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: f"Intro {n}\nShared text\nown {n}\nAfter {n}" for n in (1, 2, 3)}


def test_blocks_of_pages(spark):
    rows = [(i, f"http://host/p/{i:04d}", f"<p>menu of all</p><p>own {i}</p>") for i in range(300)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert all(r.text == f"own {r.page_id}" and r.n_shared == 1 for r in got) and len(got) == 300


def test_pairing_against_all_pairs(spark):
    """Pairs, alignment and text by trying every page of the host; copies are passed over; markup without hints."""
    rng = random.Random(20)
    rows = []
    for host in range(6):
        site = [f"site {host} line {k}" for k in range(4)]
        for n in range(rng.randint(1, 8)):
            lines = [f"own {host} {n} {k}" for k in range(rng.randint(0, 4))] + rng.sample(site, rng.randint(0, 4))
            rng.shuffle(lines)
            body = "".join(f"<div>{x}</div>" for x in lines)
            rows += [(len(rows) + k, f"http://h{host}/{rng.choice('ab')}/{rng.choice('ab')}{n}", body) for k in range(1 + (n == 2))]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    cut = 0
    for host in range(6):
        groups = {}  # pages with the same lines are one
        for i, url, html in rows:
            if url.startswith(f"http://h{host}/"):
                lines = tuple(x for x, _, _ in pages.lines_of(html))
                groups.setdefault(lines, []).append((url.split("/", 3)[3], i))
        order = sorted(groups, key=lambda x: min(groups[x]))
        for place, mine in enumerate(order):
            path = min(groups[mine])[0]
            near = [((pages._closeness(min(groups[o])[0], path), -abs(k - place), -k), o) for k, o in enumerate(order) if k != place and len(set(o) & set(mine)) <= pages.COPY * max(len(set(o)), len(set(mine)))]
            text = list(mine)
            if near and mine:
                gone = pages.shared_lines([hash(x) for x in mine], [hash(x) for x in max(near)[1]])
                text = [x for i, x in enumerate(mine) if i not in gone] or text
            for _, i in groups[mine]:
                assert got[i].text == "\n".join(text)
                cut += got[i].n_cut
    assert cut > 20


def test_runs_of_near_copies(spark):
    """Runs within a block, over several blocks and over a whole host, against a plain walk over each host."""
    rng = random.Random(8)
    body = lambda tag, own: "".join(f"<div>{x}</div>" for x in [f"{tag} {k}" for k in range(24)] + own + ["All of the site"])
    rows = [(0, "http://h/p/0000", body("first", ["own"]))]
    rows += [(i, f"http://h/p/{i:04d}", body("copy", [f"own {i}"])) for i in range(1, 200)]
    rows += [(200, "http://h/p/0200", body("last", ["own"])), (201, "http://h/p/0201", body("after", []))]
    rows += [(300 + i, f"http://all/{i:03d}", body("alike", [f"own {i}"])) for i in range(40)]
    for i in range(120):  # a slow drift, other pages and copies in turn
        tag = rng.choice("ab") if i > 60 else "a"
        rows.append((400 + i, f"http://mixed/{rng.choice('xyz')}/{i:03d}", "".join(f"<div>{tag} {k}</div>" for k in range(i // 2, i // 2 + 30)) + f"<div>own {i}</div><div>site</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.main_text(df.repartition(7)).collect()}
    assert got == {r.page_id: r for r in pages.main_text(df.repartition(3)).collect()}
    by_host = {}
    for i, url, html in rows:
        host, path = pages._address(url)
        by_host.setdefault(host, []).append((path, i, [x for x, _, _ in pages.lines_of(html)]))
    same = lambda a, b: len(set(a) & set(b)) > pages.COPY * max(len(set(a)), len(set(b)))
    beyond = 0
    for of in by_host.values():
        of.sort()
        for k, (path, i, mine) in enumerate(of):
            lo = hi = k
            while lo and same(of[lo][2], of[lo - 1][2]):
                lo -= 1
            while hi + 1 < len(of) and same(of[hi][2], of[hi + 1][2]):
                hi += 1
            sides = [x for x in (lo - 1, hi + 1) if 0 <= x < len(of) and not same(mine, of[x][2])]
            text = mine
            if sides:
                other = max(sides, key=lambda x: (pages._closeness(of[x][0], path), -abs(x - k), -x))
                gone = pages.shared_lines([hash(x) for x in mine], [hash(x) for x in of[other][2]])
                text = [x for j, x in enumerate(mine) if j not in gone] or mine
                beyond += abs(other - k) > 8
            assert got[i].text == "\n".join(text), i
    assert beyond > 100
    assert all("All of the site" not in got[i].text for i in range(202))


def test_hostile_markup_takes_linear_time():
    for part in ("<a \"", "<a ='>' =\"", "</script", "<!--", "<", "<div>", "</p>"):
        for lead in ("", "<script>", "<div>" * 1000):
            t = time.process_time()
            pages.lines_of(lead + part * (200_000 // len(part)))
            assert time.process_time() - t < 3
    assert [x for x, _, _ in pages.lines_of("<p title='a>b'>x<p>y <b c=\"> z</b>")] == ["x", "y z"]


def exact(ids, vecs, q, top=5):
    m = np.array(vecs)
    s = (m * m[q]).sum(1) / np.sqrt((m * m).sum(1)) / np.sqrt((m[q] * m[q]).sum())
    return sorted((-x, i) for x, i in zip(s.tolist(), ids, strict=True) if i != ids[q])[:top]


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((20, 16))
    vecs = [list(map(float, centre[i % 20] + 0.3 * rng.standard_normal(16))) for i in range(2000)]
    for i in range(100, 140):
        vecs[i] = vecs[100]
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    odd = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (5200, [1.0], 0), (5201, [2.0], 0), (5250, [1.0, 1.0], 0), (None, vecs[0], 0), (50, vecs[50], 1), (100, vecs[7], 2)]
    got = {}
    for r in ann.nearest_neighbours(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == {*range(0, 2000, 50), 5200}
    assert got.pop(5200) == [(1, -1.0, 5201)]  # lengths apart
    twice = sorted(got.pop(50))  # both rows are queries, and each is a candidate of the other
    assert [x[0] for x in twice] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and [x[2] for x in twice[:2]] == [50, 50]
    other = sorted(got[100], key=lambda x: x[2] in range(101, 106) or x[2] == 100)[:5]  # its second row has another vector
    assert (1, 7) in {(x[0], x[2]) for x in other}
    got[100] = [x for x in got[100] if x not in other]
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5] and [x[1:] for x in found] == sorted(x[1:] for x in found)
        want = exact(list(range(2000)), vecs, q)
        hits += len({i for _, i in want} & {x[2] for x in found})
        if q == 100:
            assert [x[2] for x in found] == [101, 102, 103, 104, 105]
    assert hits >= 0.9 * 5 * len(got)
    few = ann.nearest_neighbours(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, score int")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(7)
    cells = ann.traverse(a, b, [1] * 42, 42)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 42


@pytest.mark.parametrize("n", [1, 3])
def test_kmeans_of_few_vectors(n):
    assert len(ann.kmeans(np.eye(4)[:n], 8)) == n
