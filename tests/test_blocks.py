"""Blocks of versions against a plain tree that is searched node by node."""

import random
import re

from tidemark.functions.blocks import ANCHORS, LEAST, MOST, Outline, located, version_block


class _Node:
    def __init__(self, name, id_="", parent=None):
        self.name, self.id, self.parent, self.parts = name, id_, parent, []

    def text(self):
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def html(self):
        own = f' id="{self.id}"' if self.id else ""
        return f"<{self.name}{own}>" + "".join(p if isinstance(p, str) else p.html() for p in self.parts) + f"</{self.name}>"

    def walk(self):
        yield self
        for p in self.parts:
            if not isinstance(p, str):
                yield from p.walk()


def _tree(rng, depth=0, parent=None):
    node = _Node(rng.choice("div div section article span p2 h2 ul2".split()) if depth else "body", rng.choice(["", "", "", "", "v1.2", "n1.2x", "top"]) if rng.random() < 0.15 else "", parent)
    for _ in range(rng.randint(0, 4)):
        if depth < 6 and rng.random() < 0.6:
            node.parts.append(_tree(rng, depth + 1, node))
        else:
            node.parts.append(rng.choice(["1.2", " Updated to 1.2 ", "Updated to ", "v3.4 ", "x " * rng.randint(1, 120), "word\n", "y" * 9000 if rng.random() < 0.1 else "z"]))
    return node


def _plain(root, target):
    nodes = list(root.walk())
    title = lambda n: n.text().strip()[:120] or None
    if not target:
        n = next((n for n in nodes if n.name in ANCHORS and re.search(r"\bv?(\d+\.\d+(?:\.\d+)?)", n.text())), None)
        return n and ((n.parent or n).html(), title(n))
    for own in ("v" + target, target):
        for n in nodes:
            if n.id == own:
                return n.html(), title(n)
    for n in nodes:
        if target in n.id:
            while n is not None and n.name != "article":
                n = n.parent
            if n is not None:
                return n.html(), title(n)

    def above(n):
        for _ in range(5):
            n = n.parent
            if n is None:
                return
            if LEAST <= len(n.text()) <= MOST and target in n.text():
                yield n

    best = None
    for n in nodes:
        if n.name == "div" and re.search(r"Updated\s+to\s+", n.text()) and target in n.text():
            for m in above(n):
                if best is None or len(m.text()) > len(best.text()):
                    best = m
    if best is not None:
        return best.html(), best.text()[:120]
    n = next((n for n in nodes if n.name in ANCHORS and target in n.text()), None)
    return n and (next(above(n), n).html(), title(n))


def test_blocks():
    rng, seen = random.Random(12), 0
    for _ in range(600):
        root = _tree(rng)
        html = root.html()
        for target in ("1.2", "v1.2+build7", "9.9", None):
            want = _plain(root, re.sub(r"\+.*", "", target.removeprefix("v")) if target else "")
            got = version_block(html, target)
            assert got == want
            seen += got is not None
    assert seen > 600


def test_odd_pages():
    assert version_block(None, "1.2") is None and version_block("", None) is None and version_block("no elements 1.2", "1.2") is None
    page = Outline("<ul><li>one<li id=b>two &amp; more<br>\n</ul><p>three<div>four</div>")
    said = {(n, page.text[a:b]) for n, a, b in zip(page.name, page.frm, page.to, strict=True)}
    assert said == {("ul", "onetwo & more\n"), ("li", "one"), ("li", "two & more\n"), ("br", ""), ("p", "three"), ("div", "four")}
    assert version_block("<p>three<div id='v1.2'>four</div>", "v1.2") == ("<div id='v1.2'>four</div>", "four")


def test_rendered(spark):
    """The attempt of rendered pages finds the target's block only, with its version."""
    from tidemark.operators import changelog

    note = "This release fixes several bugs and improves the speed of searches for all of our users. " * 3
    body = "<html><body>" + "".join(f"<div class='row'><div><h3>Tool {v}</h3></div><div><p>{v} notes. {note}</p></div></div>" for v in ("3.2.0", "3.1.0")) + "<p>" + "other " * 5000 + "</p></body></html>"
    rows = [(1, "3.1.0", body), (2, "9.9", "<body><p>nothing of the kind here at all, really</p></body>"), (3, None, "<body><div><h2>Tool v2.5</h2><p>" + note + "</p></div></body>"), (4, None, None)]
    found = {r.page_id: r for r in located(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, target string, rendered string, title string")).collect()}
    assert found[1].block.html.startswith("<div class='row'><div><h3>Tool 3.1.0") and found[2].block is None and found[4].block is None and found[3].block.title.startswith("Tool v2.5")
    typed = spark.createDataFrame([(i, "changelog-page", None, None, t, "<p>x</p>", None, h) for i, t, h in rows], "page_id long, type string, repo string, feed string, target string, html string, linked string, rendered string")
    empty = spark.createDataFrame([], "repo string, draft boolean, prerelease boolean, tag_name string, body string, published_at string, name string"), spark.createDataFrame([], "feed string, ord int, target string, title string, content string")
    logs = {r.page_id: r for r in changelog.by_source(typed, *empty).collect()}
    assert (logs[1].attempt, logs[1].version, logs[1].confidence) == (8, "v3.1.0", "medium") and "3.1.0 notes" in logs[1].content and "3.2.0" not in logs[1].content
    assert logs[3].version == "v2.5" and 4 not in logs
