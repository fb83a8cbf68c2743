import html.parser
import math
import random

import pytest

from adfacts.llm import html_text as H

MENU = '<ul class="menu"><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul>'
LONG = "A sentence of the article that is long enough to be dense, with commas and full stops. " * 4
WANT = LONG.strip()


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


PAGES = {
    f"<nav>{MENU}</nav><article><h1>Title &amp; more</h1><p>{LONG}<p>{LONG}</article><footer>&copy; x</footer>":
        f"Title & more\n{WANT}\n{WANT}",
    f'<div id="header">{MENU}</div><div id="content"><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div>'
    f'<div class="sidebar">{MENU}{MENU}</div>': f"Head\n{WANT}\n{WANT}",
    f'<main><div class="cookie-notice">We use cookies on this site, accept them all please.</div><p>{LONG}</p>'
    f'<div class="comments"><p>{LONG}</p></div><form><p>Subscribe {LONG}</p></form></main>': WANT,
    f'<article><div class="ad">Buy now</div><p>a <b>bold</b>\n  <i>word</i><br>next</p><ul><li>one<li>two</ul>'
    f'<p>{LONG}</article><section id="comments"><article class="comment"><p>{LONG}{LONG}</p></article></section>':
        f"a bold word next\none\ntwo\n{WANT}",
    f"<article><header><h1>Kept head</h1></header><p>{LONG}<aside>see also</aside></article>": f"Kept head\n{WANT}",
    f"<header><h1>Site name</h1>{MENU}</header><div><p>{LONG}</p><p>{LONG}</p></div>": f"{WANT}\n{WANT}",
    f"<article><p>&eacute;&#233;&#xe9; &lt;b&gt; &unknown; R&D</p><p>{LONG}</p></article>":
        f"ééé <b> &unknown; R&D\n{WANT}",
    f'<div class="page has-sidebar"><div class="postBody"><h1>Head</h1><p>{LONG}</p>{MENU}<p>{LONG}</p></div>'
    f'<div class="siteFooter"><p>{LONG}</p></div><div id="userComments"><p>{LONG}</p></div></div>':
        f"Head\n{WANT}\n{WANT}",
    f'<div class="content"><p>{LONG}</p><div><a href="/1">One page</a> | <a href="/2">Another page</a></div>'
    f'<p>see <a href="/x">this link</a></p><div class="cookie-banner">We use them</div></div>':
        f"{WANT}\nsee this link",
    f"<article><table><tr><td>cell one<td>cell two</table><p>{LONG}</p><p hidden>secret</p></article>":
        f"cell one\ncell two\n{WANT}",
}


@pytest.mark.parametrize("body", PAGES)
def test_main_text(body):
    assert H.main_text(page(body)) == PAGES[body]


def test_pages_cut_off_anywhere_do_not_fail():
    whole = page(next(iter(PAGES)))
    for end in range(0, len(whole), 7):
        H.main_text(whole[:end])
    assert H.main_text(whole[:whole.index("</article>") - 30]).startswith("Title & more")
    assert H.main_text("<p>open <!-- never closed") == "open"
    assert H.main_text("<div " * 2000) == ""
    assert H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


@pytest.mark.parametrize("nothing", [None, "", "   ", "<html></html>", "<script>x</script>", page("")])
def test_nothing(nothing):
    assert H.main_text(nothing) == ""


def test_densities_add_up_over_children():
    root = H.parsed(page(f"<div><p>{LONG}</p><p>short <a href='x'>link</a></p></div>"))
    order = H.densities(root)
    for node in order:
        inner = [p for p in node.parts if isinstance(p, H.Node) and not p.dropped]
        assert node.chars >= sum(p.chars for p in inner)
        if inner and node.tag == "div":
            assert node.total == pytest.approx(sum(p.density for p in inner))
    link = next(n for n in order if n.tag == "a")
    assert link.density < max(n.density for n in order)


def test_query_over_edges(spark, folder):
    first = next(iter(PAGES))
    rows = [(1, "u", page(first)), (1, "u", page(first)), (None, None, page(first)), (2, "u", None), (3, "u", "")]
    out = H.QUERIES["op10_main_text"](spark, folder(pages=rows)).collect()
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in out)
    want = PAGES[first]
    assert got == sorted([("1", want, len(want))] * 2 + [("None", want, len(want)), ("2", "", 0), ("3", "", 0)])
    assert H.QUERIES["op10_main_text"](spark, folder()).collect() == []


FIVE = f"<p>{LONG}</p>" * 5


@pytest.mark.parametrize("wrapped, count", [
    (f'<div class="sec">{FIVE}</div><div class="sec">{FIVE}</div>', 10),
    (f"<section>{FIVE}</section><section>{FIVE}</section><section><p>{LONG}</p>{FIVE}</section>", 16),
    (f'<div>{FIVE}</div><div class="advert">Buy now</div><div><div>{FIVE}</div></div>', 10),
    ("<table>" + f"<tr><td>{LONG}</td><td>{LONG}</td></tr>" * 3 + "</table>", 6),
])
def test_all_wrapped_parts_of_an_article_are_taken(wrapped, count):
    tail = "<div>Copyright by the company</div>"
    got = H.main_text(page(f'<div id="content"><h1>Head</h1>{wrapped}</div>{tail}'))
    assert got.split("\n")[-count:] == [WANT] * count
    assert "Copyright" not in got
    if "<table" not in wrapped:
        assert got.startswith("Head\n")
    parts = H.main_text(page(f"{wrapped}{tail}"))
    assert parts.count(WANT) == count


@pytest.mark.parametrize("name", [
    "discussion", "related-work", "search-results", "privacy-policy", "navigation", "notice", "promotion",
    "social-history",
])
def test_parts_of_an_article_keep_names_made_of_their_headings(name):
    rest = f"<p>{LONG}</p>"
    want = f"{WANT}\nHead\n{WANT}"
    for part in (f'<section id="{name}"><h2>Head</h2><p>{LONG}</p></section>', f'<h2 id="{name}">Head</h2>{rest}',
                 f'<h2>Head</h2><p class="{name}">{LONG}</p>', f'<div class="{name}"><h2>Head</h2>{rest}</div>'):
        assert H.main_text(page(f"<article>{rest}{part}</article>")) == want
    assert H.main_text(page(f'<div id="content">{rest}<h2 id="{name}">Head</h2>{rest}</div>')) == want
    menu = f'<div id="{name}"><a href="/a">Home</a> <a href="/b">About us</a></div>'
    form = f'<div class="{name}"><p>{LONG}</p><form><input></form></div>'
    for part in (menu, form, f'<div class="{name}">Short text</div>'):
        assert H.main_text(page(f"<article>{rest}{part}</article>")) == WANT


@pytest.mark.parametrize("name", ["comments", "ad", "cookie-notice", "share_buttons", "relatedPosts", "sidebar"])
def test_boilerplate_within_an_article_goes(name):
    part = f'<div class="{name}"><h2>Head</h2><p>{LONG}</p></div>'
    assert H.main_text(page(f"<article><p>{LONG}</p>{part}</article>")) == WANT


def test_formulas_and_references_stay():
    links = "".join(f'<li><a href="/{i}">Title of paper {i}</a></li>' for i in range(3))
    titles = "\n".join(f"Title of paper {i}" for i in range(3))
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math>"
    for listed in (f"<h2>References</h2><ul>{links}</ul>", f"<section><h2>References</h2><ol>{links}</ol></section>"):
        got = H.main_text(page(f"<article><p>{LONG}</p><p>so {formula} holds</p>{listed}</article>"))
        assert got == f"{WANT}\nso x=1 holds\nReferences\n{titles}"
    menu = H.main_text(page(f"<article><p>{LONG}</p><h2>More</h2><ul>{links}</ul></article>"))
    assert menu == f"{WANT}\nMore"


def test_lists_and_tables_of_links_between_paragraphs_stay():
    names = ["First name", "Second name", "Third name"]
    links = [f'<a href="/{i}">{n}</a>' for i, n in enumerate(names)]
    for listed in ("<ul>" + "".join(f"<li>{a}</li>" for a in links) + "</ul>",
                   "<table>" + "".join(f"<tr><td>{a}</td></tr>" for a in links) + "</table>",
                   "<div><ol>" + "".join(f"<li>{a}</li>" for a in links) + "</ol></div>",
                   "<section><h2>People</h2><ul>" + "".join(f"<li>{a}</li>" for a in links) + "</ul></section>"):
        got = H.main_text(page(f"<article><h1>Head</h1><p>{LONG}</p>{listed}<p>{LONG}</p></article>"))
        assert [t for t in got.split("\n") if t != "People"] == ["Head", WANT, *names, WANT]
        # At the edges they are menus and further stories, unless numbered.
        for body in () if "<ol>" in listed else (f"<p>{LONG}</p><p>{LONG}</p>{listed}", f"{listed}<p>{LONG}</p><p>{LONG}</p>"):
            got = H.main_text(page(f"<article>{body}</article>"))
            assert [t for t in got.split("\n") if t != "People"] == [WANT, WANT]
        marked = listed.replace("<", '<div class="menu"><', 1) + "</div>"
        assert H.main_text(page(f"<article><p>{LONG}</p>{marked}<p>{LONG}</p></article>")) == f"{WANT}\n{WANT}"


def test_teasers_beside_an_article_are_not_taken_in():
    teaser = f'<div><h3><a href="/x">A long title of another story that is linked</a></h3><p>{LONG[:90]}</p></div>'
    body = f'<div class="left">{FIVE}</div><div class="right">{teaser * 4}</div>'
    assert H.main_text(page(body)) == "\n".join([WANT] * 5)


def test_a_very_long_page():
    big = f"<article><h1>Head</h1>{f'<p>{LONG}<b>bold</b></p>' * 20_000}</article><nav>{MENU * 5_000}</nav>"
    got = H.main_text(page(big)).split("\n")
    assert len(got) == 20_001 and got[0] == "Head" and set(got[1:]) == {f"{LONG}bold"}


class Naive(html.parser.HTMLParser):
    """Counts per element by walking up from every character and tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.nodes = [], []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "chars": 0, "tags": 0, "link_chars": 0, "links": 0, "inner": []}
        for above in self.open:
            above["tags"] += 1
        if tag == "a":
            for above in [*self.open, node]:
                above["links"] += 1
        if self.open:
            self.open[-1]["inner"].append(node)
        self.open.append(node)
        self.nodes.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()["tag"] == tag

    def handle_data(self, data):
        n = len("".join(data.split()))
        linked = any(node["tag"] == "a" for node in self.open)
        for i, node in enumerate(self.open):
            node["chars"] += n
            node["link_chars"] += n * linked


def naive_density(node, body):
    """The formula of composite text density, every count at least one."""
    c, t, lc, l = node["chars"], max(node["tags"], 1), node["link_chars"], max(node["links"], 1)
    if not c:
        return 0.0
    ratio = body["link_chars"] / body["chars"] if body["chars"] else 0.0
    base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
    if not lc:
        return c / t * math.log(max(c * t, math.e)) / base
    return c / t * math.log(max(c / max(lc, 1) * t / l, 1.0)) / base


def generated(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        text = " ".join(rng.choices(["some", "text", "&amp;", "of a", "page"], k=rng.randrange(0, 12)))
        if kind < 0.4:
            parts.append(f"<p>{text}</p>")
        elif kind < 0.6:
            parts.append(f'<p>{text} <a href="x">link {rng.randrange(9)}</a> <b>{text}</b></p>')
        elif depth < 4:
            parts.append(f"<div>{generated(rng, depth + 1)}</div>")
    return "".join(parts)


@pytest.mark.parametrize("seed", range(12))
def test_densities_are_those_of_a_naive_count(seed):
    body = generated(random.Random(seed))
    root, naive = H.parsed(f"<html><body>{body}</body></html>"), Naive()
    H.densities(root)
    naive.feed(f"<body>{body}</body>")
    stack = [(root, naive.nodes[0])]
    compared = 0
    while stack:
        node, other = stack.pop()
        inner = [p for p in node.parts if isinstance(p, H.Node)]
        assert [n.tag for n in inner] == [n["tag"] for n in other["inner"]]
        assert (node.chars, node.tags, node.links) == (other["chars"], other["tags"], other["links"])
        assert node.link_chars == other["link_chars"]
        assert node.density == pytest.approx(naive_density(other, naive.nodes[0]))
        sums = sum(naive_density(n, naive.nodes[0]) for n in other["inner"])
        own = naive_density(other, naive.nodes[0]) if node.tag == "p" or not sums else 0.0
        assert node.total == pytest.approx(max(sums, own))
        stack += zip(inner, other["inner"])
        compared += 1
    assert compared == len(naive.nodes)
