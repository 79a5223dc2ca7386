"""Main text of pages of many layouts, and the defined results of odd pages."""

import html as entities
import random
import re
import time

import pytest

from turnstone.llm import html

SCHEMA = "page_id bigint, url string, html string, text string, path string, host int, id int"
P1 = "The first paragraph of an article has some running text, with commas and all that."
P2 = "A second paragraph, &amp; a longer one: it tells of <b>bold</b> things&nbsp;and <a href='/x'>a link</a>, then it ends."
T1, T2 = P1, "A second paragraph, & a longer one: it tells of bold things and a link, then it ends."
NAV = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
CHROME = [
    NAV,
    "<header><h1>Site name</h1><p>Tag line of the site</p></header>",
    "<div class='header'>Site name</div>",
    "<div id='site-header'><p>Site name in a longer line of text, with commas, and more</p></div>",
    "<footer><p>&copy; 2020 Someone, all rights reserved, and so on</p></footer>",
    "<div class='footer-links'>About, contact, imprint and terms</div>",
    "<aside>Side remarks, and not a few</aside>",
    "<div class='left-sidebar'><p>Side remarks, and not a few</p></div>",
    "<div class='cookie-notice'>We use cookies, which you must accept, <button>OK</button></div>",
    "<div role='alert'>The site is down on Sunday, from one to five</div>",
    "<div class='ad'>Buy this, and that, and more of both</div>",
    "<div id='advertisement'>Buy this, and that, and more of both</div>",
    "<form action='/s'><label>Search for words</label><input name='q'><select><option>all</option></select></form>",
    "<script>var t = '</p><p>not a text';</script>",
    "<script type='text/javascript'>if (a < b && c > d) document.write('<p>no</p>');</script>",
    "<style>p > b { color: red }</style>",
    "<!-- <p>a comment that is not shown</p> -->",
    "<section class='comments'><div class='comment'><p>I disagree, said a reader, at great length, and with commas</p></div></section>",
    "<ol class='commentlist'><li>First!</li></ol>",
    "<article class='comment'><p>What a reader says in an article element of its own, at length</p></article>",
    "<div hidden>Not to be seen</div>",
    "<div style='color:red; display: none'>Not to be seen</div>",
    "<ul class='pages'><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul>",
    "<noscript>Switch on scripts</noscript><template><p>Template</p></template><svg><text>Drawn</text></svg>",
]
BODIES = [
    "<article><h1>Title</h1><p>{0}</p><p>{1}</p></article>",
    "<main><h1>Title</h1><p>{0}</p><p>{1}</p></main>",
    "<div class='content' style='overflow:hidden' data-id='sidebar'><h1>Title</h1><p>{0}<p>{1}</div>",
    "<div class='post'><h1>Title</h1><div class='text' title='hidden treasures'><p>{0}</p><p>{1}</p></div></div>",
    "<div class='entry-12'><header class='entry-header'><h1>Title</h1></header><section><p>{0}</p></section><section><p>{1}</p></section></div>",
    "<article class='post comments-open'><header><h1>Title</h1></header><div><p>{0}</p></div><div><p>{1}</p></div></article>",
    "<table><tr><td><h1>Title</h1>{0}<br>{1}</td></tr></table>",
]
NAMED_BODIES = [
    *[f"<div class='{c}'><h1>Title</h1><p>{{0}}</p><p>{{1}}</p></div>" for c in ("content has-sidebar", "site-content no-sidebar", "post comments-open", "search-results", "withSidebar", "sidebar-layout")],
    "<article><h1>Title</h1><div class='has-sidebar'><p>{0}</p></div><div class='text comments-closed'><p>{1}</p></div></article>",
]
SPREAD_BODIES = [
    "<div class='entry'><h1>Title</h1><div class='lead'><p>{0}</p></div><div class='text'><p>{1}</p></div></div>",
    "<div class='entry'><h1>Title</h1><p>{0}</p><div class='text'><p>{1}</p></div></div>",
    "<div class='entry'><h1>Title</h1><div class='lead'><p>{0}</p></div><div class='rest'><div class='text'><p>{1}</p></div></div></div>",
]


def extracted(body):
    page = body if "<body" in body else f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"
    return html.extract(page, html.vote(page)[0])


@pytest.mark.parametrize("body", BODIES)
@pytest.mark.parametrize("chrome", CHROME)
def test_layouts(body, chrome):
    said = body.format(P1, P2)
    for page in (chrome + said, said + chrome):
        assert extracted(page) == f"Title\n{T1}\n{T2}", page


@pytest.mark.parametrize("body", NAMED_BODIES)
@pytest.mark.parametrize("chrome", CHROME)
def test_names_that_tell_of_layout_or_hold_the_text(body, chrome):
    test_layouts(body, chrome)


@pytest.mark.parametrize("body", SPREAD_BODIES)
@pytest.mark.parametrize("chrome", CHROME)
def test_text_in_containers_of_different_classes(body, chrome):
    test_layouts(body, chrome)


def test_lead_and_body_of_any_length():
    for lead, rest in ((200, 2000), (1000, 1000), (2000, 200)):
        lead, rest = ("Some words of it. " * (n // 18) for n in (lead, rest))
        body = f"<div class='entry'><div class='lead'>{lead}</div><div class='text'>{rest}</div><div class='links'><a href='/'>Elsewhere, and more.</a></div></div>"
        assert extracted(f"<div class='menu-bar'>Home</div>{body}").startswith(f"{lead.strip()}\n{rest.strip()}")


def test_long_comments_are_no_article():
    page = f"<div class='post'><p>{P1}</p></div><div class='comments'><p>{P1} {P1} {P1} {P1}</p></div>"
    assert extracted(page) == T1


def test_broken_markup():
    assert extracted("<html><head><title>x</title><body><div><p>One <b>two<p>three</div>") == "One two\nthree"  # the head isn't closed
    assert extracted("<div>one</p>two</div></div></section>") == "one\ntwo"
    assert extracted("<div><p>a < b and c > d &lt;tag&gt; &amp &#233;&#x4e2d; &unknown;</div") == "a < b and c > d <tag> & é中 &unknown;"
    assert html.extract("<body><p>cut off in a <a href='x", "/body") == "cut off in a"
    assert extracted("<P CLASS=x>UPPER</P><!-- open comment <p>x") == "UPPER"
    assert extracted("<div><p>before<script>never closed <p>x") == "before"


def test_nothing_else_is_dropped():
    lines = [f"Line {k} with {k % 7} words" for k in range(3000)]
    page = "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "<ul><li><a href='/1'>a source</a></li><li><a href='/2'>another</a></li></ul><pre>x\n  y</pre></article>"
    assert extracted(page) == "\n".join([*lines, "a source", "another", "x y"])


def test_quotes_count_only_in_values():
    assert extracted(f"<div class=c><p title=it's>{P1}</p><p title=that's>{P1}</p><p>{P1}</p></div>") == f"{T1}\n{T1}\n{T1}"
    assert extracted(f"<div><p>See <a href=/o'neil>this</a> one. {P1}</p><p>{P1}</p></div>") == f"See this one. {T1}\n{T1}"
    assert extracted(f"""<div><p class="a > b" id='c > d' title=e"f>{P1}</p><p "odd' x="y>z">{P1}</p></div>""") == f"{T1}\n{T1}"
    assert extracted(f"<div><p title=>{P1}</p><img alt='x' src = 'y>z'/><p title = a=b>{P1}</p></div>") == f"{T1}\n{T1}"
    assert extracted(f"<div><p>{P1}</p><svg viewBox='0 0 1 1'/><p>Not in a <b class=x/>drawing</b>. {P1}</p></div>") == f"{T1}\nNot in a drawing. {T1}"
    assert extracted(f"<div><p>{P1}</p><svg><path d='M0'/><title>Drawn</title></svg><p>{P1}</p></div>") == f"{T1}\n{T1}"


@pytest.mark.parametrize("name", ["<div class='search-tips'>{}</div>", "<p id='share-prices'>{}</p>", "<section class='notice-period'><p>{}</p></section>", "<div class=commentary>{}</div>", "<div class='related'><p>{}</p></div>"])
def test_words_of_an_article_in_a_name_inside_it(name):
    for whole in ("article", "main"):
        assert extracted(f"{NAV}<{whole}><h1>Title</h1><p>{P1} {P1}</p>{name.format(P1)}<p>{P1}</p></{whole}>") == f"Title\n{T1} {T1}\n{T1}\n{T1}"


def test_comments_and_adverts_inside_an_article_go():
    for gone in CHROME[10:12] + CHROME[16:19] + ["<div class='comment-list'><p>I disagree. At length.</p></div>", "<ul class='share-buttons'><li><a href='/'>Share</a></li></ul>", "<div class='related'><a href='/1'>One more story to be read.</a></div>"]:
        assert extracted(f"<article><h1>Title</h1><p>{P1}</p>{gone}<p>{P1}</p></article>") == f"Title\n{T1}\n{T1}", gone


@pytest.mark.parametrize("part", ["<h2 id='{0}'>Head</h2>", "<h3 id='{0}-of-voice'>Head</h3>", "<h2 class='{0}'>Head</h2>", "<p id='{0}'>Head</p>", "<table class='{0}'><tr><td>Head</td></tr></table>", "<blockquote class='{0}'>Head</blockquote>", "<section id='{0}-hoc-networks'><p>Head</p></section>", "<div id='{0}-theory'>Head</div>", "<ul><li class='{0}'>Head</li></ul>", "<figure id='{0}'><figcaption>Head</figcaption></figure>"])
@pytest.mark.parametrize("word", sorted(html.MARKED)[::4])
def test_names_never_take_parts_of_an_article(part, word):
    for whole in ("article", "main"):
        assert extracted(f"{NAV}<{whole}><h1>Title</h1><p>{P1} {P1}</p>{part.format(word)}<p>{P1}</p></{whole}>") == f"Title\n{T1} {T1}\nHead\n{T1}"


@pytest.mark.parametrize("part", ["<ul class='search-tips'><li>Head</li></ul>", "<div class='related-work'><p>Head</p></div>", "<section id='consent'><p>{1}</p></section>", "<div class='ad-hoc'><p>Head</p></div>", "<section class='cookie-recipe'>Head</section>", "<div id='sponsor'><p>{1}</p></div>"])
def test_names_that_say_other_things_make_but_a_doubt(part):
    shown = T1 if "{1}" in part else "Head"
    assert extracted(f"<article><h1>Title</h1><p>{P1} {P1}</p>{part.format('', P1)}<p>{P1}</p></article>") == f"Title\n{T1} {T1}\n{shown}\n{T1}"


def test_a_host_resolves_doubts_about_short_texts(spark):
    page = lambda n: f"<article><h1>Title</h1><p>{P1} {P1}</p><div class='related-work'><p>{n}</p></div><p>{P1}</p></article>"
    rows = [(k, f"http://differ/{k}", page(f"House {k}")) for k in range(5)] + [(10 + k, f"http://same/{k}", page("Buy it")) for k in range(5)]
    found = {i: t for i, _, t in got(spark, rows)}
    assert all(found[k] == f"Title\n{T1} {T1}\nHouse {k}\n{T1}" for k in range(5))
    assert all(found[10 + k] == f"Title\n{T1} {T1}\n{T1}" for k in range(5))


def timed(make, n):
    page = make(n)
    began = time.perf_counter()
    html.extract(page, html.vote(page)[0])
    return time.perf_counter() - began


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + P1, lambda n: "<div><p>x" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<article class=notice>" * n + P1 * 3, lambda n: "<ul><li><div class='share'>" * n + P1, lambda n: "</div>" * n + "<p>x" * n, lambda n: "<a " * n, lambda n: "<p x=" * n, lambda n: "<p x='" * n, lambda n: "".join(f"<div class=c{chr(97 + k % 26)}>" for k in range(n)) + P1])
def test_time_is_in_proportion_to_the_length(make):
    timed(make, 1000)
    assert timed(make, 100_000 // 3) < 10


def generated(rng):
    """A page and its article's blocks: chrome around and in it, inline markup, odd white space, character references."""
    blocks, body = [], []
    wrap = rng.choice(("<article>{}</article>", "<main class=page-2>{}</main>", "<div class='post'>{}</div>", "<div class='outer'><div class='entry has-sidebar'>{}</div></div>", "<div id=content><section>{}</section></div>"))
    whole = wrap.startswith(("<article", "<main"))

    def said():
        words = [rng.choice(("the", "tale", "Ärger", "a < b", "R&D", "notice", "x=1", "it's", "中文", "42")) for _ in range(rng.randrange(12, 40))]
        words[0] = "So"
        text = " ".join(words) + "."
        marked = [rng.choice(("<b>{}</b>", "<em class=search>{}</em>", "{}", "{}", "{}", "<span title=it's>{}</span>")).format(entities.escape(w) if rng.random() < 0.7 else entities.escape(w).replace("e", "&#101;")) for w in text.split(" ")]
        return text, rng.choice((" ", "\n  ", "\t")).join(marked)

    for _ in range(rng.randrange(2, 8)):
        text, marked = said()
        kind = rng.choice(("<p>{}</p>", "<p>{}", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<section><p>{}</p></section>", "{}<br>"))
        if kind == "{}<br>" and body and not body[-1].endswith(">"):
            kind = "<p>{}</p>"
        blocks.append(text)
        body.append(kind.format(marked))
        if kind == "<p>{}":
            body.append("<div></div>")
        if whole and rng.random() < 0.5:  # headings, tables and lists, with names of any kind
            word, title = rng.choice(sorted(html.MARKED)), rng.choice(("Cookies", "Share of voice", "Related work", "What they said"))
            named = rng.choice((f" id='{word}'", f" id={word}-{rng.randrange(9)}", f" class='{word}'", f" class='{word}-size big'", ""))
            made = rng.choice(("<h2{1}>{0}</h2>", "<h3{1}>{0}</h3>", "<table{1}><tr><td>{0}</td></tr></table>", "<ul><li{1}>{0}</ul>", "<p{1}>{0}</p>", "<blockquote{1}>{0}</blockquote>", "<dl><dt{1}>{0}</dl>"))
            blocks.append(title)
            body.append(made.format(title, named))
        if rng.random() < 0.3:
            body.append(rng.choice(("<script>var a = '<p>no</p>';</script>", "<!-- <p>no --> ", "<style>p > a {}</style>", "<div class='ad-slot'>Buy it now. And again.</div>", "<aside><p>Beside it. At length.</p></aside>", "<form><input><button>Go</button></form>", "<section id=comments><p>First! I said so.</p></section>")))
    before, after = ("".join(rng.sample(CHROME, rng.randrange(0, 5))) for _ in range(2))
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{wrap.format(''.join(body))}{after}</body></html>", "\n".join(blocks)


def test_generated_pages_give_the_article_they_were_made_from():
    for seed in range(400):
        page, want = generated(random.Random(seed))
        assert html.extract(page, html.vote(page)[0]) == want, (seed, page)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def got(spark, rows):
    found = html.main_text(table(spark, rows)).collect()
    assert all(r.n_chars == len(r.text) for r in found)
    return sorted(((r.page_id, r.url, r.text) for r in found), key=repr)


def test_a_host_agrees_on_a_path(spark):
    layout = "<html><body><div class='side'><p>{1}</p></div><div class='story-{2}'><p>{0}</p></div></body></html>"
    rows = [(k, f"https://A.example.com/{k}", layout.format("Words of the story, told at length. " * 6, "Short.", k)) for k in range(5)]
    odd = (9, "http://a.example.com:80/9", layout.format("A short story, told in one line.", "Out of the box, this is longer than it. ", 7))
    far = (10, "https://b.example.com/", odd[2])
    found = dict((i, t) for i, _, t in got(spark, [*rows, odd, far]))
    assert found[0] == ("Words of the story, told at length. " * 6).strip()
    assert found[9] == "A short story, told in one line."  # its host knows better
    assert found[10] == "Out of the box, this is longer than it."
    assert html.vote(odd[2])[0] == "/html/body/div.side"


def test_a_host_tells_recurring_from_varying_parts(spark):
    def page(k, n):
        return f"<article><h1>Title</h1><p>{P1} {P1}</p><div class='notice'><p>{n}</p></div><p>{P1}</p></article>"

    same = [(k, f"http://same/{k}", page(k, "We have moved to another house, and sell there.")) for k in range(6)]
    differ = [(10 + k, f"http://differ/{k}", page(k, f"On this day, {k} houses were moved, and sold there.")) for k in range(6)]
    alone = [(20, "http://alone/", page(0, "We have moved to another house, and sell there."))]
    found = {i: t for i, _, t in got(spark, same + differ + alone)}
    assert all(found[k] == f"Title\n{T1} {T1}\n{T1}" for k in range(6))
    assert all(found[10 + k] == f"Title\n{T1} {T1}\nOn this day, {k} houses were moved, and sold there.\n{T1}" for k in range(6))
    assert found[20] == f"Title\n{T1} {T1}\nWe have moved to another house, and sell there.\n{T1}"


def test_a_very_long_page(spark):
    text = "Words of the story, told at length. " * 60_000
    (row,) = got(spark, [(1, "http://h/1", f"<nav>x</nav><div>{text}</div>")])
    assert row[2] == text.strip()


def test_odd_rows(spark):
    page = "<article><p>Just a text.</p></article>"
    rows = [(1, "http://h/1", None), (2, "http://h/2", ""), (3, None, page), (4, "no url", page), (None, "http://h/3", page), (5, "http://h/4", page), (5, "http://h/4", page), (6, "http://h/5", "<nav>only</nav>"), (7, "http://h/6", "plain text\n only")]
    want = [(i, u, {None: "", "": "", page: "Just a text.", "<nav>only</nav>": "", "plain text\n only": "plain text only"}[h]) for i, u, h in rows]
    assert got(spark, rows) == sorted(want, key=repr)
    assert got(spark, []) == []


def test_pages_of_the_test_data(spark):
    """Their articles, cut out by their one template."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert found[r.page_id] == "\n".join(b for b in blocks if b), r.page_id
