"""Main text of pages: marked and unmarked pages, broken markup, templates counted over a host, odd rows."""

import random
import re
import time
from collections import defaultdict

import pytest

from caldrift.llm import page_text

SCHEMA = "page_id long, url string, html string, host string, no int, blocks string"


def text(html):
    return " ".join(page_text.parse(html)[0])


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp text &#233;&eacute;&nbsp;x", "plain & text éé x"),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p><b>One<br><p>Two <i>th</i>ree</article><footer>f</footer>", "T One Two three"),
        ("<script>var t='</p><article>no</article>'</script><article>A<!-- <p>no</p> --><style>p{}</style>B</article>", "AB"),
        ("<nav><ul><li>a<li>b</ul><article><p>yes</p></article>", "yes"),  # a nav never closed
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p title='x > y' data-a=it's>in</p></article> <p cut='", "in"),
        ("<article><header><h1>Head</h1><p>by me</p></header><p>Body</p><aside>no</aside><form><input value=1>no<button>no</button></form></article>", "Head Body"),
        ("<article><p>Body</p><section id=comments><article class=comment><h1>Long</h1><p>no no no no no no no no</p></article></section></article>", "Body"),
        ("<article><p>Body</p><article><p>an unmarked reply</p></article></article>", "Body"),
        ("<article class='post has-sidebar comments-open'><p>Body</p></article><article class=comment>no</article>", "Body"),
        ("<main><h1>T</h1><p>Body text</p><div class='cookie-notice'>no</div><section><h2>3 Comments</h2><p>no</p></section></main><div>no</div>", "T Body text"),
        ("<div id=page><div class=top-menu><a>no</a></div><div id=content><h1>T</h1><p>A long enough body of text.</p></div><div class=sidebar>no</div></div>", "T A long enough body of text."),
        ("<div class=header>no</div><h1>T</h1><p>Body</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p hidden>no</p>", "T Body"),
        ("<form id=aspnet><div><article><p>kept</p></article></div></form>", "kept"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul><pre>p\n q</pre>z</article>", "a b c x y p q z"),
        ("<article><p>a<span class=ad>no <span>no</span> no</span> b</p></article>", "a b"),
        ("<ARTICLE><P>up</P></ARTICLE><div role=navigation>no</div>", "up"),
        ("<article><p>x</p><noscript>no</noscript><textarea>no</article></textarea><select><option>no</select><p>y</p></article>", "x y"),
    ],
)
def test_by_marks(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    began = time.time()
    assert text("<div>" * 30000 + "x" + "</p>" * 30000) == "x"
    assert len(text("<article>" + "<p>word &amp; word" * 60000)) == 60000 * 12 - 1
    assert time.time() - began < 20


def rows(spark, pages):
    return spark.createDataFrame([(i, u, h, "h", 1, "b") for i, u, h in pages], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))


def test_templates_of_unmarked_pages(spark):
    """Pages without article or main: boxes of the site go by recurring, on this host only, whatever they say."""
    rng = random.Random(2)
    box, top = "<div><p>Read all about us in this box of the site</p><p>and more</p></div>", "<div><span>Site of sites</span></div>"
    pages, want = [], {}
    for i in range(12):
        own = [words(rng, 15) for _ in range(3)]
        pages.append((i, f"http://A.example/{i}?x=1", f"<body>{top}<div>{''.join(f'<p>{t}</p>' for t in own)}</div>{box}"))
        want[i] = " ".join(own)
    pages.append((20, "https://user@b.example:80/", f"{box}<p>{words(rng, 90)}</p>"))
    got = {r.page_id: r for r in page_text.main_text(rows(spark, pages).repartition(3)).collect()}
    assert {i: got[i].text for i in want} == want and all(got[i].n_chars == len(want[i]) and got[i].n_templates >= 2 for i in want)
    assert got[20].text.startswith("Read all about us") and got[20].n_templates == 0


def test_menu_of_a_section_of_a_site(spark):
    """On unmarked pages a box without prose goes at a tenth of the host's pages, a paragraph only at half of them."""
    rng = random.Random(4)
    pages = [(i, f"http://a.example/{i}", f"<p>{words(rng, 12)} {i}</p>" + ("<p>A passage on some pages.</p><div><span>Go up</span></div>" if i % 5 == 0 else "")) for i in range(40)]
    got = {r.page_id: r for r in page_text.main_text(rows(spark, pages)).collect()}
    assert all(got[i].text.endswith("A passage on some pages." if i % 5 == 0 else f" {i}") and got[i].n_templates == (i % 5 == 0) for i in range(40))


def test_copies_and_shared_passages_stay(spark):
    """Exact copies count once, and paragraphs of an article stay however often they recur."""
    passage = "A passage that very many articles of this host have in common, word for word."
    copy = "<div><article><h1>Copy</h1><div><p>The same article</p><p>once more and again</p></div></article></div>"
    pages = [(i, f"http://a.example/{i}", copy) for i in range(40)] + [(100 + i, f"http://a.example/{i}", f"<article><h1>Intro</h1><p>{passage}</p><p>Own text {i}</p><div>Tell a friend</div></article>") for i in range(60)]
    got = {r.page_id: r.text for r in page_text.main_text(rows(spark, pages)).collect()}
    assert all(got[i] == "Copy The same article once more and again" for i in range(40))
    assert all(got[100 + i] == f"Intro {passage} Own text {i}" for i in range(60))


def test_counts_against_brute_force(spark):
    rng = random.Random(3)
    pages = [(i, rng.choice(["http://a.example/", "http://b.example/x", None, "no host"]), "".join(rng.choice(["<div>one</div>", "<ul><li>two</ul>", "<p>three</p>", "<section><div>one</div></section>", f"<p>{rng.random()}</p>"]) for _ in range(rng.randrange(9)))) for i in range(80)]
    seen, main = defaultdict(set), defaultdict(set)
    for _, url, html in pages:
        if url and (host := re.match(r"http://(\w\.example)", url)):
            blocks, subtrees = page_text.parse(html)
            main[host[1]].add(" ".join(blocks))
            for t in subtrees:
                seen[host[1], t["hash"]].add(" ".join(blocks))
    want = {(h, t, len(s), len(main[h])) for (h, t), s in seen.items() if len(s) >= page_text.MANY_PAGES}
    df = rows(spark, pages)
    parsed = df.select("page_id", "url", "html").mapInArrow(page_text._parse, page_text.PARSED)
    assert {tuple(r) for r in page_text.templates(parsed).select("host", "hash", "n", "pages").collect()} == want and want


def test_odd_rows(spark):
    assert page_text.main_text(rows(spark, [])).count() == 0
    pages = [(None, None, None), (1, "http://a.example", " \n"), (1, "http://a.example", "<article>x"), (1, "http://a.example", "<article>x"), (2, "mailto:x", "<article>y</article>")]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in page_text.main_text(rows(spark, pages)).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "http://a.example", "", 0), (1, "http://a.example", "x", 1), (1, "http://a.example", "x", 1), (2, "mailto:x", "y", 1)], key=str)
