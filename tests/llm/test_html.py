import math
import random
import re

from pyspark.sql import functions as F

from windlass.llm import html as H
from windlass.llm.common import Scratch


def test_blocks_and_noise():
    page = (
        '<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>'
        '<article><header><h1>Head &amp; tail</h1></header><p><b>One\n two<br><p>Three &lt;x&gt;</p><div class="share-buttons">Share</div><ul><li>a<li>b</ul><form><input>Mail</form></article>'
        '<section id="comments"><p>Nice</p></section><aside>Side</aside><footer>&copy; x'
    )
    assert H.main_text(page) == "Head & tail\nOne two\nThree <x>\na\nb"


def test_without_article():
    assert H.main_text("<body><div>x <i>y</i> z</div>tail<div class='cookie-notice'>ok</div>") == "x y z\ntail"


def test_edges():
    assert H.main_text(None) == H.main_text("") == "" and H.main_text("plain  text") == "plain text"
    assert H.main_text("<p>a<!-- open <p>b") == "a" and H.main_text("a<script>b") == "a" and H.main_text("a < b") == "a < b"
    assert H.host(None) == "" and H.host("http://[bad") == "" and H.host("HTTP://Www.X.org:80/a") == "www.x.org"


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='top'>Same on all pages</div><div class='story'><p>Story {i} tells {i * 7}</p></div></body>") for i in range(20)]
    rows += [(90, None, None), (91, "http://other.org/", "<div class='top'>Same on all pages</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(spark, df).collect()}
    assert got[3] == "Story 3 tells 21" and got[90] == "" and got[91] == "Same on all pages" and len(got) == 22
    assert H.extract(spark, df.limit(0)).count() == 0


def test_style_tree_looks_at_every_sibling(spark):
    def page(i):
        return f"<body><div class='row'>Story {i} tells {i * 7}</div><div class='row'>More of {i * 3}</div><div class='row'>Contact us</div></body>"

    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(spark, df).collect()}
    assert got[3] == "Story 3 tells 21\nMore of 9\nContact us"


def test_deep_paths_stay_apart(spark):
    def page(i):
        deep, end = f"<div class='block'>x{i} " * 60, "</div>" * 60
        return f"<body><section class='a'>{deep}<div class='end'>Same on all pages</div>{end}</section><section class='b'>{deep}<div class='end'>Story {i}</div>{end}</section></body>"

    df = spark.createDataFrame([(i, f"http://h.org/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(spark, df).collect()}
    assert "Story 3" in got[3] and "Same on all pages" not in got[3]


def test_one_host_on_both_sides(spark):
    page = "<body><div class='top'>Same on all pages</div><div class='story'><p>Story {}</p></div></body>"
    rows = [(i, f"http://h.org/a b|{i}", page.format(i)) for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3"


def test_importance_against_the_definition(spark):
    rng = random.Random(2)
    words = ["tea", "sea", "bee"]

    def page(i):
        rows = "".join(f"<li>{rng.choice(words)}</li>" for _ in range(rng.choice([1, 1, 2])))
        return f"<body><div class='a'>{rng.choice(words)}</div><ul class='b'>{rows}</ul><p>{i if i % 3 else 'same'}</p></body>"

    rows = [(f"http://h{i % 3}.org/{i}", page(i)) for i in range(40)]
    got = {(r.host, r.path): (r.n, r.importance) for r in H.style_tree(spark.createDataFrame(rows, "url string, html string"), Scratch(spark, "t")).collect()}
    seen: dict = {}
    for url, html in set(rows):
        for tag, sig, found in (("div", ".a", re.findall(r"<div class='a'>(.*?)</div>", html)), ("ul", ".b", re.findall(r"<ul class='b'>(.*?)</ul>", html)), ("p", "", re.findall(r"<p>(.*?)</p>", html))):
            path = H._path(H._path(H._path("", "body"), tag + sig), "")
            path = H._path(H._path("", "body"), tag + sig)
            kinds = ["".join(re.findall(r"[a-z0-9]+", re.sub(r"</?li>", " ", x))) for x in found], [" ".join(["li"] * x.count("<li>")) for x in found]
            for k, kind in enumerate(kinds):
                seen.setdefault((H.host(url), path), ({}, {}))[k].setdefault(str(kind), set()).add(html)

    def entropy(groups):
        c = [len(g) for g in groups.values()]
        n = sum(c)
        return n, (-sum(x / n * math.log(x / n) for x in c) / math.log(n) if n > 1 else 1.0)

    own = {}
    for key, (content, layout) in seen.items():
        (n, a), (_, b) = entropy(content), entropy(layout)
        own[key] = n, 0.8 * a + 0.2 * b
    for (host, path), (n, x) in own.items():
        others = [(m, y) for (_, q), (m, y) in own.items() if q == path and m > 1]
        everywhere = sum(m * y for m, y in others) / sum(m for m, _ in others) if others else 1.0
        assert got[host, path][0] == n and math.isclose(got[host, path][1], (n * x + H.PRIOR * everywhere) / (n + H.PRIOR), rel_tol=1e-9)


def test_the_tree_judges_articles_too(spark):
    page = "<body><article><h1>Title {0}</h1><p>Story {0} of {1}</p><div class='box'><p>Read our terms</p></div></article></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, i * i)) for i in range(20)] + [(50, "http://small.org/", page.format(50, 1))]
    got = {r.page_id: r.text for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3\nStory 3 of 9"
    assert got[50].startswith("Title 50\nStory 50 of 1")  # one page says little, the other host's tell more


def test_a_teaser_is_not_the_page():
    body = "".join(f"<p>Paragraph {i} of the story that this page tells at length.</p>" for i in range(9))
    page = f"<body><div class='story'>{body}</div><article><h2>Read next</h2></article></body>"
    text = H.main_text(page)
    assert text.startswith("Paragraph 0") and text.endswith("Read next") and text.count("\n") == 9
    assert H.main_text(f"<body><p>Lead</p><article>{body}</article></body>").startswith("Paragraph 0")
    assert H.main_text("<body><p>Only this</p><article> </article></body>") == "Only this"


def test_repeats_clashing_columns_hot_host_and_a_long_page(spark):
    rows = [(i % 300, f"http://hot.org/{i % 300}", f"<body><div class='top'>Same</div><p>Story {i % 300}</p></body>", f"x{i}") for i in range(600)]
    rows += [(1000 + i, f"http://h{i}.org/", f"<p>Own {i}</p>", None) for i in range(50)]
    rows += [(5000, "http://hot.org/long", "<body><div class='top'>Same</div><p>" + "word " * 200_000 + "</p></body>", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("low", F.lit(1)).withColumn("salt", F.lit("s"))
    out = H.extract(spark, df)
    got = sorted(((-1 if r.page_id is None else r.page_id), r.text, r.n_chars) for r in out.collect())
    want = [(i % 300, f"Story {i % 300}") for i in range(600)] + [(1000 + i, f"Own {i}") for i in range(50)] + [(5000, ("word " * 200_000).strip()), (-1, "")]
    assert got == sorted((i, t, len(t)) for i, t in want) and out.columns == ["page_id", "url", "text", "n_chars"]
