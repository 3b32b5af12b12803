import time

import pytest

from defgrain.llm import template_removal as t

SITE = "<html><head><title>T</title></head><body><div class=x1>Buy now at <a href=/>our shop</a> today</div>{}<div><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div></body></html>"


def text(html, templates=()):
    return t.Page(html).main_text(set(templates))


def test_blocks_and_references():
    assert text("<article><h1>A &amp; B</h1><p>x&nbsp;y<br>z <b>bold</b>er<p>&#233; &lt;tag&gt;</article>") == "A & B\nx y z bolder\né <tag>"
    assert text("<p>a  \n b</p>c<div>d<span> e</span></div>") == "a b\nc\nd e"
    assert text("<table><tr><td>1<td>2<tr><td>3</table><ul><li>x<li>y</ul>") == "1\n2\n3\nx\ny"
    assert text("plain") == "plain" and text("") == text(None) == "" == text("<!-- x -->")


def test_named_boilerplate_goes():
    page = (
        "<body><header><h1>Site</h1></header><nav>menu</nav><aside>side</aside><div class='cookie-notice'>cookies</div>"
        "<main><article><header><h1>Title</h1></header><p>Text one.</p><div class=ad>Buy</div><script>var a='</p>';</script>"
        "<p>Text <span class='share'>share</span>two.</p><form><p>Mail</p><input></form><footer>foot</footer></article>"
        "<section id=comments><article class=comment><p>Nice!</p></article></section></main>"
        "<footer>&copy; me</footer><div hidden>h</div><p style='display: none'>n</p></body>"
    )
    assert text(page) == "Title\nText one.\nText two."


def test_names_of_wrappers_do_not_take_the_text():
    long = "word " * 40
    assert text(f"<div class='ad-free content'><p>{long}</p></div><div class='ad'>x</div>") == long.strip()
    assert text(f"<article class='post has-comments'><p>{long}</p><div class=comments>{long}{long}</div></article>") == long.strip()
    assert text(f"<div class='site-header'>Name</div><div class=page><div class='post-header'><h1>T</h1></div><p>{long}</p></div>") == f"T\n{long.strip()}"
    assert text(f"<div id='comments'>{long}{long}</div><p>Short text.</p>") == "Short text."


def test_broken_markup():
    assert text("<article><p><b>t<br><p>one</p><p>two</p></article><footer>f</footer>") == "t\none\ntwo"
    assert text("<p>a</div></span>b<p>c") == "a\nb\nc" or text("<p>a</div></span>b<p>c") == "ab\nc"
    assert text("<article><p>a <!-- unclosed") == "a"
    assert text('<article><p title="x > y">a</p><p title="unclosed>b</p></article>')
    assert text("<p>a < b and c > d</p>") == "a < b and c > d"
    assert text("<article><style>p{}") == "" and text("<article>x<script>y") == "x"


def test_very_long_and_deep_pages():
    assert len(text("<article>" + "<p>word word</p>" * 50_000 + "</article>").split("\n")) == 50_000
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<" * 100_000) == "<" * 100_000
    for tag in ("font", "b", "div", "a", "p", "li", "ul"):  # work per token must not grow with what is open
        began = time.monotonic()
        assert text(f"<{tag}>" * 100_000 + "x") == "x"
        assert time.monotonic() - began < 20
    assert text("<p><button><b>" + "<div>" * 50_000 + "x") == ""


def test_teasers_are_not_the_article():
    long = "word " * 200
    assert text(f"<article>Short teaser.</article><div><p>{long}</p></div>") == f"Short teaser.\n{long.strip()}"
    assert text(f"<article><p>{long}</p></article><div><p>Other text.</p></div>") == long.strip()


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"http://user@Site.example:80/p{i}", SITE.format(f"<p>Only on page {i}, with words of its own.</p><p>{'word ' * 30}{i}</p>")) for i in range(12)]
    rows += [(100, "http://other.example/", SITE.format("<p>Lone page.</p><p>More text follows here.</p>"))]
    rows += [(101, None, None), (102, "", ""), (103, "no url", "<p>x</p>"), (None, "http://other.example/", "<p>y</p>"), (3, rows[3][1], rows[3][2])]
    return rows


@pytest.mark.parametrize("max_broadcast", [10**6, 0])
def test_recurring_subtrees_go(spark, pages, max_broadcast):
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host_key string, hash int").repartition(3)
    got = [(r["page_id"], r["text"]) for r in t.main_text(df, max_broadcast=max_broadcast).collect()]
    by = dict(got)
    assert len(got) == len(pages)
    for i in range(12):
        assert by[i] == f"Only on page {i}, with words of its own.\n{'word ' * 30}{i}"
    assert by[100].startswith("Buy now")  # a host with one page has no template
    assert by[101] == by[102] == "" and by[103] == "x" and by[None] == "y"
    assert all(r["n_chars"] == len(r["text"]) for r in t.main_text(df).collect())
    assert t.main_text(df.where("false")).count() == 0


def test_copied_articles_stay(spark):
    same = "<article><h1>Same</h1><p>Copied text on many pages.</p><div><a href=/>All news</a></div></article>"
    df = spark.createDataFrame([(i, "http://h/", f"<nav>n</nav>{same}<p>{i}</p>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in t.main_text(df).collect()} == {"Same\nCopied text on many pages."}


def test_parsing_equals_a_walk_over_all_open_elements():
    """Random markup against a plain form that looks through the whole stack at every token."""
    import random

    rng = random.Random(3)
    tags = "div p b a span li ul td table tr article main header button section option select dt dd dl body".split()
    for _ in range(400):
        html = "".join(
            rng.choice([f"<{g}>", f"</{g}>", f"<{g} class=ad>", "x ", "<br>"]) for g in rng.choices(tags, k=rng.randrange(1, 25))
        )
        page = t.Page(html)
        stack, opened = [("", 0)], []
        for m in t._TOKEN.finditer(html):
            name = (m[2] or "").lower()
            names = [n for n, _ in stack]
            if m[1] == "/":
                if name in names and name != "body":
                    depth = max(d for d, n in enumerate(names) if n == name)
                    if name in t.BLOCK or not any(n in t.BLOCK for n in names[depth:]):
                        del stack[depth:]
                continue
            for open_tag, starters in t.CLOSED_BY.items():
                if name in starters:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == open_tag:
                            del stack[depth:]
                            break
                        if stack[depth][0] in t.FENCE[open_tag]:
                            break
            if name in t.VOID or (name == "body" and name in [n for n, _ in stack]):
                continue
            opened.append((name, stack[-1][1]))
            stack.append((name, len(opened)))
        assert list(zip(page.tag[1:], page.parent[1:])) == opened, html


def test_counts_and_removal_equal_brute_force(spark, pages):
    """Template lists from plain counting over all pages."""
    seen, sizes = {}, {}
    for _, url, html in pages:
        host = "site.example" if url and "Site" in url else "other.example" if url and "other" in url else ""
        sizes[host] = sizes.get(host, 0) + 1
        for h in t.Page(html).candidates():
            seen[host, h] = seen.get((host, h), 0) + 1
    want = sorted(h for (host, h), n in seen.items() if n >= 5 and n >= 0.05 * sizes[host])
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = sorted(h & (1 << 64) - 1 for r in t.site_templates(df).collect() for h in r["hashes"])
    assert got == want and want
