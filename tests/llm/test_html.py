import math
import random
import re
from html import unescape

from conftest import SMALL
from textlab.llm import html as H
from textlab.llm.registry import op5_site_style_tree


def article_only(source):
    """What lies between the article tags of the given pages, cut at block tags."""
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div|li|ul)\b[^>]*>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = op5_site_style_tree(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_only(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_blocks_and_references():
    source = """<!DOCTYPE html><html><head><title>T &amp; t</title></head><body><header>site</header><div>one
      <b>two</b>&nbsp;&lt;3 <!-- no <p> --> four</div><p>five<p>six <i>se</i>ven<br>eight<ul><li>nine<li>ten</ul>
      <article><header><h1>head</h1></header><p a="x>y">body &euro;</p><section class="user-comments"><p>me too</p></section></article>
      <script>if (a < b) "</p>";</script><form><p>mail</p></form><div class="Cookie-Notice">ok</div><p>tail &amp;copy; &unknown; <a href="/">link</a>"""
    assert H.main_text(source, set()).split("\n") == [
        "one two <3 four", "five", "six seven eight", "nine", "ten", "head", "body €", "tail &copy; &unknown; link",
    ]


def test_broken_markup():
    assert H.main_text("a < b && c > d", set()) == "a < b && c > d"
    assert H.main_text("</p></div>x<p>y</b>z<script>open", set()) == "x\nyz"
    assert H.main_text(None, set()) == H.main_text("", set()) == H.main_text("<p>", set()) == ""
    deep = "<div>" * 3_000 + "core" + "</div>" * 3_000 + "<p>after"
    assert H.main_text(deep, set()) == "core\nafter"
    assert len(H.main_text("<p>" + "word " * 100_000, set())) == 499_999


def site(host, n, rng, words):
    pages = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(rng.choices(words, k=25))}</p>" for _ in range(rng.randrange(2, 6)))
        strip = "<div class=x1><span>Start</span> <span>Contact us</span></div><div class=x2>All rights reserved by " + host + "</div>"
        pages.append((f"http://{host}/{i}", f"<body>{strip}<div class=x3>{body}</div><div class=x4>We like {rng.choice(['a', 'b'])}</div></body>"))
    return pages


def test_repeated_branches_without_telling_names_go(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    pages = site("a.org", 40, rng, words) + site("b.org", 30, rng, words) + site("c.org", 1, rng, words)
    rows = [(i, u, h, "x") for i, (u, h) in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, noise string")).collect()}
    assert len(got) == 71
    for i, (_, source) in enumerate(pages):
        assert got[i] == "\n".join(re.findall(r"<p>(.*?)</p>", source)), i


def test_importance_is_the_entropy(spark):
    rows = [("h", 1, 0, 10, 3), ("h", 1, 0, 11, 1), ("h", 1, 1, 20, 4), ("h", 1, 1, 21, 1), ("h", 2, 0, 10, 1)]
    seen = spark.createDataFrame(rows, "host string, node long, kind int, value long, n long")
    got = {r["node"]: (r["m"], r["importance"]) for r in H.importance(seen, "host").collect()}
    styles = -(0.75 * math.log(0.75, 4) + 0.25 * math.log(0.25, 4))
    content = 1 - (4 * 1 + 1 * 0) / 5
    assert got[1][0] == 4 and abs(got[1][1] - (0.19 * styles + 0.81 * content)) < 1e-12
    assert got[2] == (1, 1.0)


def test_copies_of_an_article_stay(spark):
    page = "<nav><a href=x>Menu</a></nav><article><h1>Same</h1><p>Same words.</p></article><footer>f</footer>"
    df = spark.createDataFrame([(1, f"http://h.org/{i}", page) for i in range(50)] + [(None, None, None), (2, "", "")], "page_id long, url string, html string")
    rows = H.extract(df).collect()
    assert [r["text"] for r in rows if r["page_id"] == 1] == ["Same\nSame words."] * 50
    assert [r["text"] for r in rows if r["page_id"] != 1] == ["", ""]
    assert H.extract(df.limit(0)).count() == 0


def test_names_of_headings_and_other_topics_stay():
    inside = "<section id='related-work'><h2 id='search'>A</h2><p id='social-policy'>b</p><p class=share>c</p></section><div class='site-footer'>f</div>"
    assert H.main_text(f"<article>{inside}</article>", set()) == "A\nb\nc"
    assert H.main_text("<div class='social-policy'>x</div><div id='main-nav'>y</div><div class='ad-slot-2 big'>z</div>", set()) == "x"


def test_tree_decides_within_an_article(spark):
    """Boilerplate without telling names goes from articles that differ; on few pages the name weighs more."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, want = [], {}
    for i in range(43):
        host = "many.org" if i < 40 else "few.org"
        body = [" ".join(rng.choices(words, k=25)) for _ in range(rng.randrange(2, 6))]
        notice = "Get our letter each week"
        page = f"<main><h1>{' '.join(rng.choices(words, k=5))}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"<div class=x{host[0]}><p>{notice}</p></div></main>"
        rows.append((i, f"http://{host}/{i}", page))
        want[i] = body + ([notice] if host == "few.org" else [])
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"].split("\n")[1:] for r in got} == want
