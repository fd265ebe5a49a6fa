import math
import re
from html import unescape

import duckdb
import pytest

from sparkloom.llm import html_text as h


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain  &amp; text", "plain & text"), ("<nav><a href=x>Home</a></nav>", ""),
    ("<body><nav>Menu</nav><article><h1>T &lt;1&gt;</h1><p><b>One<br><p>Two <i>x</i>y\n z<!-- no --><aside>side</aside></article><footer>f</footer>", "T <1>\nOne\nTwo xy z"),
    ("<div id=menu><a>a</a></div><div class='content'><p>Long paragraph of words here, and more of it.<p>Second one, too, is long enough.<div class='comments'><p>nice post, but a reader wrote it</div></div><div class=sidebar>links and so on</div>", "Long paragraph of words here, and more of it.\nSecond one, too, is long enough."),
    ("<article><p>a<script>var t='</p>';</script>b</p><form><p>mail</p></form><ul><li>x<li>y</ul></article>", "a b\nx\ny"),
    ("<main><section><p>" + "long text " * 50 + "</p></section><section><p>short</p></section></main>", ("long text " * 50).strip() + "\nshort"),
    ('<p title="a>b">kept</p>', "kept"), ("<article>" * 3000 + "deep", "deep"),
])
def test_main_text(html, text):
    assert h.main_text(html) == text


LONG = "Long paragraph of words here, and more of it."


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'title="Hidden gems"', "data-x='class=menu'", 'class="content has-sidebar"', 'class="layout no-sidebar"', 'class="page with-header"', "id=search"])
def test_wrappers(attributes):
    """A wrapper is not chrome for a word in another attribute's value, nor for a class when the article is in it."""
    for inner in (f"<article><p>{LONG}</p></article>", f"<main><p>{LONG}</p></main>", f"<p>{LONG}</p>", f"<div class=with-sidebar><p>{LONG}</p></div>"):
        assert h.main_text(f"<body><div {attributes}>{inner}<div class=sidebar>links</div></div><div class=comments><p>A note.</p></div></body>") == LONG


def test_marked_stays_chrome():
    assert h.main_text(f"<p>{LONG}</p><div hidden>{LONG * 3}</div><div HIDDEN=''>x</div><div role=banner>{LONG * 3}</div>") == LONG
    assert h.main_text(f"<article><p>{LONG}</p><div class=comments><article>{'A reader. ' * 2}</article></div></article>") == LONG
    assert h.main_text(f"<article><p>{LONG}</p></article><div class=comments>{'A reader wrote this. ' * 9}</div>") == LONG


TOPICS = "<ul class=topics>" + "".join(f"<li><a href=/{k}>Topic number {k}</a></li>" for k in range(9)) + "</ul>"
BODY = "".join(f"<p>Paragraph {k} of the story, long enough to be read as one.</p>" for k in range(6))
STORY = "\n".join(f"Paragraph {k} of the story, long enough to be read as one." for k in range(6))


@pytest.mark.parametrize("html,text", [
    (f"<body><div id=wrap>{TOPICS}<div>{BODY}</div></div></body>", STORY),
    (f"<body><div id=wrap>{TOPICS}<div>{STORY}</div></div></body>", " ".join(STORY.split())),
    (f"<body><div id=wrap><h1>Title</h1>{TOPICS}<div><div>{BODY}</div></div><div><div><a>x</a></div>{TOPICS}</div></div></body>", f"Title\n{STORY}"),
    (f"<body><div id=wrap><div>{BODY}</div><div><span>Buy</span> <b>now</b></div></div></body>", STORY),
    (f"<body>{TOPICS}{BODY}{TOPICS}</body>", STORY),
    (f"<main>{TOPICS}<div>{BODY}</div></main>", STORY),
    (f"<body><div>By <b>A</b> and <a>B</a><div>{BODY}</div></div></body>", f"By A and B\n{STORY}"),
    (f"<main><article class=post>{BODY}</article><article class=comment><p>A reader.</p></article><article role=complementary><p>Other.</p></article></main>", STORY),
    (f"<article class='hentry comments-open'>{BODY}</article><article class='comment-body'><p>A reader.</p></article>", STORY),
    (f"<article class='hentry'>{BODY}</article><article><p>Part two, short.</p></article>", f"{STORY}\nPart two, short."),
    (f"<article class=comment>{BODY}</article><article class=comment><p>Two.</p></article>", f"{STORY}\nTwo."),
])
def test_selection(html, text):
    assert h.main_text(html) == text


def test_all_pages(spark):
    """The pages' articles by a plain cut between their tags."""
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(spark.read.parquet(path)).collect()}
    for page, html in duckdb.sql(f"SELECT page_id, html FROM '{path}'").fetchall():
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<(?:b|/b|br)>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        want = "\n".join(x for x in lines if x)
        assert got[page] == (want, len(want))


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "c"), (1, "u", "<p>a</p>", "c"), (None, None, None, "c")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, h.extract(rows).collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)]
    assert h.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("html,text", [
    (f"<article><p>{LONG}</p><p class='notice-period'>The notice period is thirty days.</p></article>", f"{LONG}\nThe notice period is thirty days."),
    (f"<body><div><h2 class='section-header'>Part one</h2>{BODY}</div></body>", f"Part one\n{STORY}"),
    ("<div id='widget'><p>Only this stands here.</p></div>", "Only this stands here."),
    (f"<article><p>Let <math><mi>x</mi></math> be <button>a word</button>.</p><object><p>{LONG}</p></object></article>", f"Let x be a word.\n{LONG}"),
    (f"<article>{BODY}<section><h3>Reader comments (2)</h3><p>Nice one, says a reader of this page.</p><p>Another says less.</p></section></article>", STORY),
    (f"<article>{BODY}<div class='cookie-notice'><p>We use cookies.</p></div><div class='siteHeader'>Name</div></article>", STORY),
    (f"<body><div>{BODY}</div><section><h2>Comments</h2><p>Nice one, says a reader.</p></section></body>", STORY),
])
def test_names_and_comments(html, text):
    assert h.main_text(html) == text


def plain_density(node, page):
    """The composite density of a node by counting below it, from the definition."""
    def below(n):
        return [n, *(y for x in n.items if isinstance(x, h.Node) and not x.chrome for y in below(x))]

    def chars(n):
        return sum(len(x) - x.count(" ") - x.count("\n") for y in below(n) for x in y.items if isinstance(x, str))

    def linked(n):
        return [y for x in below(n) if x.tag == "a" for y in below(x)]

    def four(n):
        inside = list({id(y): y for y in linked(n)}.values())
        top = [y for y in below(n) if y.tag == "a" and not any(z.tag == "a" for z in y.above() if z in below(n) and z is not n or z is n and n.tag == "a")]
        return chars(n), max(1, len(below(n)) - 1), sum(map(chars, top)), len([y for y in inside if y is not n or n.tag == "a"])

    c, t, lc, lt = four(node)
    ratio = four(page)[2] / max(1, chars(page))
    base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
    if c and base == 1.0:  # no link on the page: the logarithm's base would be 1, so the natural one serves
        return c / t * math.log(max(1, c * t))
    return c / t * math.log(max(1, c / max(1, lc) * t / max(1, lt)), base) if c else 0.0


def test_density_by_counting():
    page = h.parse(f"<body><div><p>{LONG}</p><p>See <a>here</a> and <a><b>there</b></a>.</p></div><ul><li><a>One</a><li><a>Two</a></ul></body>")
    nodes = h.weigh(page)
    assert len(nodes) == 13
    for n in nodes:
        assert n.density == pytest.approx(plain_density(n, page)), n.tag
        assert n.total == pytest.approx(sum(plain_density(x, page) for x in n.items if isinstance(x, h.Node)))
    assert max(nodes, key=lambda n: n.total).tag == "div"


LINKS = "<ul>" + "".join(f"<li><a href=/r{k}>Source number {k}</a></li>" for k in range(5)) + "</ul>"
SOURCES = "\n".join(f"Source number {k}" for k in range(5))
SIGNED = "".join(f"<li><cite>Reader {k}</cite><p>I liked it, number {k}.</p></li>" for k in range(3))


@pytest.mark.parametrize("html,text", [
    # article text that must stay
    (f"<article>{BODY}<section><h2>Discussion</h2><p>The results agree with earlier ones.</p></section></article>", f"{STORY}\nDiscussion\nThe results agree with earlier ones."),
    (f"<article>{BODY}<section><h2>Responses</h2><p>The council gave two of them.</p></section></article>", f"{STORY}\nResponses\nThe council gave two of them."),
    (f"<article>{BODY}<h2>References</h2>{LINKS}</article>", f"{STORY}\nReferences\n{SOURCES}"),
    (f"<article>{BODY}<section>{LINKS}</section></article>", f"{STORY}\n{SOURCES}"),
    (f"<body><div id=wrap><div>{BODY}<h2>References</h2>{LINKS}</div></div></body>", f"{STORY}\nReferences\n{SOURCES}"),
    (f"<article>{BODY}<section id=search><p>The search for the ship went on.</p></section><div class=related><p>A related matter came up.</p></div></article>", f"{STORY}\nThe search for the ship went on.\nA related matter came up."),
    # what must go
    (f"<article>{BODY}<script src=/a/b/>var x=1;</script><style media=x/>p {{}}</style></article>", STORY),
    (f"<article><p>{LONG}</p></article><p>Subscribe now to our letter.</p><p>Buy the new thing today.</p>", LONG),
    (f"<article>{BODY}<section><h2>Discussion (3)</h2><ul>{SIGNED}</ul></section></article>", STORY),
    (f"<article>{BODY}</article><section><h2>What our readers say</h2><p>Nice one.</p><p>So it is.</p></section>", STORY),
    (f"<article>{BODY}<div class=post-comments><p>Nice one.</p></div></article>", STORY),
    (f"<article>{BODY}<article><p>Nice one, says a reader.</p></article></article>", STORY),
    (f"<article>{BODY}</article><article><span class=author>Ann</span><p>Nice one.</p></article>", STORY),
    (f"<article>{BODY}</article><article><h3><a href=/x>Another story</a></h3><p>What it is about.</p></article>", STORY),
    (f"<article>{BODY}<div class=ad-slot-1>Buy it</div><div class=share-buttons>Tell all</div><div class=newsletter-signup-form>Our letter</div><div data-ad-id=7>Buy more</div></article>", STORY),
    (f"<article>{BODY}<label>Your mail <input></label><p style='color:red; display: none'>Unseen.</p></article>", STORY),
    (f"<article>{BODY}<div class=related><p>Read <a href=/x>Another story</a></p></div></article>", STORY),
])
def test_contract(html, text):
    assert h.main_text(html) == text


def test_winner_by_counting():
    """The node chosen on pages without an article element is the one of the largest sum of densities, counted for all nodes."""
    import random

    rng = random.Random(11)

    def grown(depth):
        if depth == 0 or rng.random() < 0.3:
            return "".join(f"<p>{'word ' * rng.randrange(1, 60)}</p>" if rng.random() < 0.7 else f"<a href=x>{'link ' * rng.randrange(1, 5)}</a>" for _ in range(rng.randrange(1, 5)))
        return "".join(f"<div>{grown(depth - 1)}</div>" for _ in range(rng.randrange(1, 4)))

    for _ in range(30):
        html = f"<body>{grown(3)}</body>"
        page = h.parse(html)
        nodes = h._nodes(page)
        sums = {n: sum(plain_density(x, page) for x in n.items if isinstance(x, h.Node) and not x.chrome) for n in nodes}
        best = max(nodes, key=lambda n: round(sums[n], 9))
        wanted = h.blocks(best)
        got = h.main_text(html).split("\n")
        assert all(x in got for x in wanted if not x.startswith("link") and "link" not in x)


def test_long_page():
    """A page of megabytes is read whole, in time that grows with its length."""
    html = f"<nav>{'<a href=x>menu</a>' * 20000}</nav><article>" + "".join(f"<p>Paragraph {k} of a long story.</p>" for k in range(60_000)) + "</article>"
    assert h.main_text(html).count("\n") == 59_999
