import random
import time
from collections import Counter

import pytest

from corvane.llm import html
from corvane.llm.html import Page, host_of, text_of

SCHEMA = "page_id long, url string, html string"


def page(article, nav="<nav><a href=/>Home</a></nav>", rest=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{nav}<article>{article}</article>{rest}<footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        (page("<h1>A &amp; B</h1><p>one\n  two&nbsp;three</p><p>x<br>y"), "A & B\none two three\nx y"),
        (page("<p><b>Bold.<br><p>Next <i>one</i></p>"), "Bold.\nNext one"),
        (page("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"), "a\nb\nc\nd"),
        (page("<p>a &lt;b&gt; 1 < 2 > 0 &#8364;&#x41;</p>"), "a <b> 1 < 2 > 0 €A"),
        (page("<p>in</p>", rest="<aside>side</aside><div class='comments'><article><p>me too</p></article></div>"), "in"),
        (page("<header><h1>Title</h1><p>by me</p></header><p>in</p><div class='share-bar'>share</div><form>f</form><!-- <p>no</p> -->"), "Title\nin"),
        (page("<p>a<span class='ad'>buy</span>b</p><p hidden>h</p><p style='display: none'>n</p>"), "ab"),
        ("<body><div id=main-menu>m</div><div><h2>H</h2>text</div><div role=navigation>n</div><noscript>js</noscript>", "H\ntext"),
        ("<main><p>m</p></main><p>outside</p>", "m"),
        ("<p>cut off <a href='x", "cut off <a href='x"),
        ("<p>a<p>b</p></div></p>c", "a\nb\nc"),
        ("<script>if (a < b) { x('<p>') }</script><p>ok", "ok"),
        ("<body><div class='has-sidebar'><p>text</p><div class=sideBar>s</div></div>", "text"),
        ("<body><div class='layout sidebar-right'><h1>All</h1><p>of it</p></div><nav>n</nav>", "All\nof it"),
        ("<body><div class=sidebar-right><article><p>in</p></article><p>out</p></div>", "in"),
        ("<title>t</title><p>no head tags</p>", "no head tags"),
    ],
)
def test_one_page(source, want):
    assert text_of(source) == want


def test_hosts():
    assert [host_of(u) for u in ("http://A.example.com/x", "https://u:p@b.org:8080?q", "//c.net", "nothing", None)] == ["a.example.com", "b.org", "c.net", "", ""]


def site(n, host="s.example.com", box="<div class='x1'>Welcome to the site</div>"):
    return [(i, f"http://{host}/{i}", f"<body>{box}<div><p>Story number {i} is told here at length.</p><p>Often quoted.</p></div><div>Imprint</div></body>") for i in range(n)]


def test_template_is_removed_and_small_sites_are_not_touched(spark):
    rows = site(12) + [(100 + i, f"http://two.example.com/{i}", h) for i, (_, _, h) in enumerate(site(2))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "Story number 3 is told here at length."
    assert got[100] == "Welcome to the site\nStory number 0 is told here at length.\nOften quoted.\nImprint"


def test_copies_of_one_article_are_no_template(spark):
    rows = [(i, f"http://s.com/{i}", page("<div><p>The one story of this site, many times.</p></div>", rest=f"<p>{i}</p>")) for i in range(30)]
    assert {r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"The one story of this site, many times."}


def test_broadcast_and_join_agree(spark):
    rows = site(12) + site(9, "three.com", "<ul><li>One</li><li>Two</li></ul>") + [(900, None, None), (901, None, "<p>x"), (902, "http://s.example.com", "")] + site(1)
    df = spark.createDataFrame([(*r, 7, "u") for r in rows], SCHEMA + ", n_chars int, text string")
    a, b = (sorted(map(tuple, html.extract(df, broadcast=n).collect()), key=repr) for n in (1000, 0))
    assert a == b and len(a) == len(rows)
    assert html.extract(df.limit(0)).collect() == []


def test_long_page():
    text = text_of(page("".join(f"<p>word{i} &amp; more</p>" for i in range(50_000))))
    assert text.count("\n") == 49_999 and text.endswith("word49999 & more")
    assert len(text_of("<div>" * 20_000 + "deep")) == 4
    assert Page("<" * 3000).kept()


NOTICE = "<div class='x2'>" + "All that is written here is owned by the publisher and may not be used without leave. " * 6 + "</div>"


@pytest.mark.parametrize("inside", [False, True])
def test_notice_longer_than_the_articles_is_a_template(spark, inside):
    links = "<div class='x3'><div>Start</div><div>All the stories</div></div>"
    around = "<body><article>{}</article></body>" if inside else "<body>{}</body>"
    rows = [(i, f"http://s.com/{i}", around.format(f"{links}<div><p>Story number {i} is told here at length.</p></div>{NOTICE}")) for i in range(12)]
    # each story stands at a second address too, with another box around it
    rows += [(100 + i, f"http://s.com/print/{i}", h.replace("All the stories", "Printed stories")) for i, _, h in rows]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k + i: f"Story number {i} is told here at length." for i in range(12) for k in (0, 100)}


def test_copies_with_dates_are_no_template(spark):
    story = "The one story of this site, which many pages repeat word by word."
    rows = [(i, f"http://s.com/{i}", f"<body><div class=a><p>{story}</p></div><div class=b>{i} May 2024, 10:{i}</div></body>") for i in range(30)]
    assert all(story in r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body><div id=content><p>" + "The story goes on. " * 20 + "</p></div><article><p>Next story</p></article><article><p>Other</p></article>", ("The story goes on. " * 20).strip()),
        ("<body><h1>The title</h1><article><p>The text.</p></article>", "The title\nThe text."),
        ("<body><h1>The title</h1><p>Lead-in by the desk</p><main><p>The text.</p></main>", "The title\nThe text."),
        ("<body><div class=comments><p>I was first!</p></div>", ""),
        ("<body><article class='comment opinion'><p>A piece of opinion.</p></article><ol class=comment-list><li><article><p>No!</p></article></li></ol>", "A piece of opinion."),
        ("<body><div class=ad-box><p>Buy now</p></div><div id=cookie-notice>We use them.</div>", ""),
        ("<body><div class=widget><p>All that there is.</p></div>", "All that there is."),
    ],
)
def test_choice_of_the_article(source, want):
    assert text_of(source) == want


STORY = "The story is told at length, and goes on from there. "


@pytest.mark.parametrize(
    ("source", "want"),
    [
        # a story next to cards that are articles, each of a quarter of the text
        (f"<body><h1>T</h1><div id=content><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></div><article><p>{STORY}{STORY}</p></article><article><p>{STORY}</p></article>", "T\n" + "\n".join([STORY.strip()] * 3)),
        (f"<body><article class='post notice-board'><h1>T</h1><p>{STORY}</p></article><p>Around it</p>", f"T\n{STORY.strip()}"),
        (f"<body><div class='search-results-page widget'><article><p>{STORY}</p></article></div><p>Cookie policy text</p>", STORY.strip()),
        (f"<body><article><p>Short.</p></article><div class=related><article><p>{STORY}</p></article></div>", "Short."),
        (f"<body><form id=aspnet><div><p>{STORY * 5}</p><input name=x></div></form>", (STORY * 5).strip()),
        (f"<body><form><article><p>{STORY}</p><form><p>Sign up</p></form></article><p>Search here</p></form>", f"{STORY.strip()}\nSign up"),
        (f"<body><p>Text</p><form><p>{STORY * 5}</p></form>", "Text"),
        (f"<body><article><p>{STORY}</p><form><p>Sign up</p></form></article>", STORY.strip()),
        ("<body><form><p>Name</p><p>Mail</p></form>", ""),
        ("<body><div class=menu><a href=/>Home</a> <a href=/a>About</a></div>", ""),
        ("<body><div id=main-nav>Home</div><div class=sideBar><p>Side</p></div><div class='left sidebar'><p>Side</p></div>", ""),
        (f"<body><div class=post><p>{STORY}</p></div><div class=discussion><p>First!</p></div><ol class=commentlist><li>Second</ol>", STORY.strip()),
        (f"<body><article><p>{STORY}</p><section id=discussion><h2>Discussion</h2><p>We find.</p></section></article>", f"{STORY.strip()}\nDiscussion\nWe find."),
    ],
)
def test_stories_stay_and_boxes_go(source, want):
    assert text_of(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<!-- no end <p>b</p> > c", "a"),
        ("<p>a<!-- no end", "a"),
        ("<p>a</p>b <!", "a\nb <!"),
        ("<p>a<!--->b<!-->c<!-- d --!>e", "abce"),
        ("x <a <a <b", "x <a <a <b"),
        ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "a\nb\nc\nd"),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "a\nb\nc\nd"),
        ("<p><b>a<div>b</p>c</b></div>d", "a\nbc\nd"),
    ],
)
def test_broken_markup(source, want):
    assert text_of(source) == want


BROKEN = ["<a ", "<script ", "<b><p>x</p>", "<p>x", "<b>x", "<div>x", "<i class=ad>x", "<li>x<b>", "</p>", "<!-- ", "<td>x<p>", "<a '>", '<a "', "&amp", "<", "<div><i>", "<title>", "<form><p>x"]


@pytest.mark.parametrize("piece", BROKEN)
def test_time_grows_with_the_length_alone(piece):
    """Some 0.6 MB of each; what takes the square of that takes minutes."""
    for source in (piece * (600_000 // len(piece)), "<b>" * 20_000 + "<p>x</p>" * 20_000, piece * (300_000 // len(piece)) + ">"):
        start = time.process_time()
        text_of(source)
        assert time.process_time() - start < 10


def test_a_page_without_an_id(spark):
    rows = [(None, "http://a.org", "<p>a"), (1, None, None), (None, None, "<p>a")]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(None, "http://a.org", "a", 1), (1, None, "", 0), (None, None, "a", 1)], key=repr)


def planted(seed, hosts=6, pages=14):
    """Sites whose boxes have no telling names: (page, its story, how many boxes the page has)."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"word{rng.randrange(4000)}" for _ in range(n))
    out = []
    for h in range(hosts):
        boxes = [f"<div class=b{k}><p>{text(rng.choice([4, 30, 90]))}</p></div>" for k in range(4)]
        for i in range(pages):
            own = [b for b in boxes if rng.random() < 0.8]
            story = [text(rng.choice([6, 40, 200])) for _ in range(3)]
            body = "".join(own[: len(own) // 2]) + "<div>" + "".join(f"<p>{s}</p>" for s in story) + "</div>" + "".join(own[len(own) // 2 :])
            out.append(((h * 100 + i, f"http://h{h}.org/{i}", f"<body>{body}</body>"), "\n".join(story), len(own)))
    return out


def test_planted_boxes_are_found_and_stories_stay(spark):
    """By the template alone: no name, tag or role tells the boxes from the stories."""
    data = planted(3)
    got = {r.page_id: r for r in html.extract(spark.createDataFrame([d[0] for d in data], SCHEMA)).collect()}
    assert all(got[row[0]].text == story and got[row[0]].n_template == n for row, story, n in data)
    assert all(text_of(row[2]) != story for row, story, n in data if n)


def test_templates_are_counted_as_by_hand(spark):
    """Every subtree of every page, counted per host in different pages' contents, without Spark."""
    rows = [d[0] for d in planted(5, 3, 12)] + site(15, "s.org") + [(900 + i, f"http://s.org/x{i}", h) for i, _, h in site(4, "s.org")]
    hosts = {}
    for _, url, source in set((0, u, h) for _, u, h in rows):
        hosts.setdefault(host_of(url), set()).add(source)
    want = set()
    for host, sources in hosts.items():
        parsed = {s: Page(s) for s in sources}
        blocks = {s: html.telling(p.kept()) for s, p in parsed.items()}
        spread = Counter(b for own in blocks.values() for b in own)
        content = {s: min(own, key=lambda b: (spread[b], -own[b], html._signed(html._hash(b)))) for s, own in blocks.items()}
        seen = {}
        for s, p in parsed.items():
            for key in p.keys():
                seen.setdefault(key, set()).add(content[s])
        want |= {(html._signed(html._hash(host)), html._signed(k)) for k, who in seen.items() if len(who) >= max(3, 0.1 * len(set(content.values()))) or len(who) >= html.MANY}
    assert {tuple(r) for r in html.templates(spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(want) > 10


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_a_box_of_a_section_of_a_large_site(spark, broadcast):
    """On 60 of a host's 900 pages; a quotation on 30 of them stays, as it may be part of a story."""
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(5000)}"
    rows, want = [], {}
    for i in range(900):
        story = " ".join(word() for _ in range(12))
        box = "<div class=x7><p>More of our cooking pages</p></div>" if i < 60 else ""
        quoted = "<p>As the saying goes, so it is.</p>" if i % 30 == 0 else ""
        rows.append((i, f"http://big.org/{i}", f"<body><div><p>{story}</p>{quoted}</div>{box}</body>"))
        want[i] = story + ("\nAs the saying goes, so it is." if quoted else "")
    assert {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA), broadcast=broadcast).collect()} == want
