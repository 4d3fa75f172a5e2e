"""Fields from markup, against a tree of elements built by Python's parser."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from textlab.functions import markup as M


class Node:
    def __init__(self, tag, parent):
        self.tag, self.parent, self.parts = tag, parent, []

    @property
    def children(self):
        return [p for p in self.parts if isinstance(p, Node)]

    def text(self, sep=""):
        return sep.join(p if isinstance(p, str) else sep + p.text(sep) + sep for p in self.parts)

    def flat(self):
        for c in self.children:
            yield c
            yield from c.flat()


class Dom(HTMLParser):
    """Open elements end as a browser ends them, for the tags the tests use."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", None)
        self.feed(page)
        self.close()

    def path(self):
        node, out = self.now, []
        while node.parent:
            out.append(node)
            node = node.parent
        return out

    def end(self, tags, within):
        for node in self.path():
            if node.tag in within:
                return
            if node.tag in tags:
                self.now = node.parent
                return

    def handle_starttag(self, tag, attrs):
        for starts, ended, within in (
            (("td", "th"), ("td", "th"), ("table",)), (("tr",), ("tr",), ("table",)), (("tbody",), ("tbody",), ("table",)),
            (("li",), ("li",), ("ul", "table")), (("p", "h1", "h2", "div", "ul", "table"), ("p",), ("td", "th", "table")),
        ):
            if tag in starts:
                self.end(ended, within)
        node = Node(tag, self.now)
        self.now.parts.append(node)
        if tag not in ("br", "img"):
            self.now = node

    def handle_endtag(self, tag):
        self.end((tag,), () if tag == "table" else ("table",))

    def handle_data(self, data):
        self.now.parts.append(data)


def norm(text):
    return " ".join(text.split())


def plain_value(page, label):
    """The four rules as paths over the tree; of each the first match in document order."""
    nodes = list(Dom(page).root.flat())
    after = {n: n.parent.children[n.parent.children.index(n) + 1 :] for n in nodes}
    exact = [n for n in nodes if norm(n.text()) == label]
    found = [
        {next((s for s in after[n] if s.tag == "td"), None) for n in exact if n.tag == "td"},
        {next((s for s in after[n] if s.tag == "td"), None) for n in exact if n.tag == "th"},
        {next(iter(after[n]), None) for n in exact},
        {row.children[1] if len(row.children) > 1 else None for n in nodes if label in norm(n.text()) and (row := closest_row(n))},
    ]
    for matches in found:
        first = next((n for n in nodes if n in matches), None)
        if first is not None and norm(first.text(" ")):
            return norm(first.text(" "))
    return None


def closest_row(node):
    node = node.parent
    while node and node.tag != "tr":
        node = node.parent
    return node


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "cell", "row", "table", "li", "inline", "p", "void", "stray", "label"] if depth < 5 else ["text", "label", "void"])
        inner = random_page(rng, depth + 1) if kind not in ("text", "void", "stray", "label") else ""
        close = rng.random() < 0.7
        tag = {"cell": rng.choice(["td", "th", "TD"]), "row": "tr", "table": "table", "li": "li", "inline": rng.choice(["b", "span", "div", "h2", "ul"]), "p": "p"}.get(kind)
        if tag:
            out.append(f"<{tag} class='x'>{inner}" + f"</{tag}>" * close)
        else:
            out.append({"text": rng.choice(["a &amp; b", " ", "Lab", "el", "x\n y"]), "void": rng.choice(["<br>", "<img src=a>"]), "stray": rng.choice(["</td>", "</tr>", "</b>", "</table>", "</p>"]), "label": rng.choice(["Label", "<td>Label</td>", "<th> <b>Label</b> </th><td>v</td>", "<span>Label</span>", "La<i>bel</i>", "<td>is Label: </td><td>w</td>"])}[kind])
    return "".join(out)


def test_values_as_in_the_tree(spark):
    rng = random.Random(6)
    pages = [f"<html><body><table><tr>{random_page(rng)}</tr></table>{random_page(rng)}</body></html>" for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(8)
    got = {r.i: r.v for r in frame.select("i", M.label_value(F.col("html"), "Label").alias("v")).collect()}
    want = {i: plain_value(p, "Label") for i, p in enumerate(pages)}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (pages[wrong[0]], got[wrong[0]], want[wrong[0]], len(wrong))
    assert sum(v is not None for v in want.values()) > 200 and sum(v is None for v in want.values()) > 30


NESTED = "<table><tr><td>Out<table><tr><td>Label<td>inner</table></td><td>second</td></tr></table>"


@pytest.mark.parametrize(
    "page, value",
    [
        (NESTED, "inner"),
        ("<table><tr><td>a Label b<table><tr><td>x</table><td>outer", "outer"),
        ("<table><tr><td>Label<th>not<td>this", "this"),
        ("<table><tr><th>Label</th><th>not</th><td>this</td></tr><tr><td>Label<td></table>", "this"),
        ("<div>Label</div> text <br><p>no</p>", None),
        ("<ul><li>Label<li>next<li>last</ul>", "next"),
        ("<dl><dt>Label<dd>meaning</dl>", "meaning"),
        ("<table><tr><td>the Label<td>beside<td>third", "beside"),
        ("<p>Label</p>", None),
        ("", None),
        (None, None),
    ],
)
def test_rules(one, page, value):
    assert one(lambda x: M.label_value(x.cast("string"), "Label"), x=page) == value


def test_headings_left_open(one):
    assert one(M.page_heading, x="<title>T</title><h1>Open <b>one<h2>Two</h2>") == "Open one Two"
    assert one(M.page_heading, x="<title>T</title><h1></h1><h2>Two</h2>") == "Two"
    assert one(M.page_heading, x="<TITLE>Only &amp; title") == "Only & title"
    assert one(lambda x: M.page_heading(x.cast("string")), x=None) is None
