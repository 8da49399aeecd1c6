import itertools

import numpy as np

from tarnfield.llm import pages


def subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for (i, x), (j, y) in itertools.product(enumerate(a), enumerate(b)):
        table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 20)) for _ in range(2))
        found = pages.common(a, b)
        assert found == sorted(found) and len(found) == subsequence(a, b)
        assert subsequence(a[found], b) == len(found)


def test_blocks_read_markup():
    html = """<html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
    <header>Top</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad-box"><p>Buy</p></div><p>Lead
    <article class="post"><h1>Head &amp; more</h1><p>One<br>two <b>bold&nbsp;x <p>Next &lt;p&gt; &#233;
    <aside>Side</aside><form><input value=a>Form</form><ul><li>a<li>b</ul><div class=comments><p>Me too</div></article>
    <div class="has-sidebar">Rest</div><!-- <p>no</p> --><footer>Foot</footer>"""
    assert [t for t, part in pages.blocks(html) if part == 2] == ["Head & more", "One two bold x", "Next <p> é", "a", "b"]
    assert [t for t, part in pages.blocks(html) if part == 1] == ["Lead", "Rest"]


def page(*blocks):
    return "<body>" + "".join(f"<div>{b}</div>" for b in blocks) + "</body>"


def test_template_lines_go_but_copies_stay(spark):
    long = "own words of the page that nobody else has written " * 4
    rows = [
        (1, "http://h.org/a/1", page("Site", "Go", long + "1", "All rights"), 0),
        (2, "http://h.org/a/2", page("Site", "Go", long + "2", "All rights"), 0),
        (3, "http://h.org/b/1?x=/a", page("Site", "New", long + "3", "All rights"), 0),
        (4, "http://x.org/1", page("Site", "Go", long + "4"), 0),
        (5, "http://y.org/1", page("Same", long), 0),
        (6, "http://y.org/2", page("Same", long), 0),
        (6, "http://y.org/2", page("Same", long), 0),
        (7, None, None, 0),
        (None, "", "", 0),
        (8, "http://h.org/a/3", "<article><p>Go<p>" + long + "</article><p>All rights", 0),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = pages.main_text(df)
    texts = {(r["page_id"], r["url"]): r["text"] for r in found.collect()}
    own = long.strip()
    assert found.count() == 10 and found.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert [texts[i, u] for i, u, *_ in rows] == [
        long + "1", long + "2", "Site\n\nNew\n\n" + long + "3", "Site\n\nGo\n\n" + long + "4", "Same\n\n" + own, "Same\n\n" + own,
        "Same\n\n" + own, "", "", "Go\n\n" + own,
    ]
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
    assert pages.main_text(df.limit(0)).count() == 0


def test_a_host_over_many_ranges(spark):
    rows = [(i, f"http://h.org/{i:05d}", page("Menu", f"Text number {i} of its own kind and length", "Foot")) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    assert {r["text"] for r in pages.main_text(df).collect()} == {f"Text number {i} of its own kind and length" for i in range(600)}
