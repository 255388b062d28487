import html
import re
import time

import pytest

from brindle.llm import pages
from brindle.session import table
from tests.conftest import SF


def by_article(page):
    """What the given pages hold in their article element, by its own tags."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1|br|li|ul)[^>]*>", inner)
    clean = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def test_query_on_the_table(spark):
    found = {r.page_id: r for r in pages.op4_html_extraction(spark, SF).collect()}
    given = table(spark, SF, "pages").collect()
    assert len(found) == len(given)
    for p in given:
        assert found[p.page_id].text == by_article(p.html)
        assert found[p.page_id].n_chars == len(found[p.page_id].text)


LAYOUT = """<html><body><div id="top-nav" class="menu m12"><a href=x>Home of all things and more</a></div>
<div class="cookie-notice">We use cookies and more cookies and far more cookies than you would ever think of.</div>
<div class="wrap w{n}"><div class="post-body b{n}"><h1>T{n} &amp; co</h1><p>First&nbsp;para with <i>some</i>
  words&#33; and a &lt;tag&gt;<p>Second one, unclosed<ul><li>item one<li>item two</ul><form>Search: <input></form></div>
<div class="comments"><p>{long}</p></div></div><div class="sidebar">{long}</div><script>var s = "<p>no</p>";</script><footer>End {long}</footer></body></html>"""


def test_other_layouts_and_votes(spark):
    long = "words that are not the article, again and again, " * 9
    rows = [(i, f"http://h.org/{i}", LAYOUT.format(n=i, long=long), "x") for i in range(4)]
    rows += [(10, "http://h.org/y", "<div class='wrap w9'><div class='post-body b9'>Alone</div></div>", "x"), (11, None, None, "x"), (12, "no", "", "x"), (13, "http://h.org/z", "just text <b>bold", "x")]
    rows += [(14, "http://h.org/z", "<p>" + "deep <div>" * 3_000 + "<!-- open " + "x" * 9_000, "x"), (15, "http://h.org/z", "<a title=\"unclosed>t</a><p>text 1 < 2", "x")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {r.page_id: r.text for r in pages.extract_pages(given).collect()}
    for i in range(4):
        assert found[i] == f"T{i} & co\nFirst para with some words! and a <tag>\nSecond one, unclosed\nitem one\nitem two"
    assert found[10] == "Alone" and found[11] == "" and found[12] == "" and found[13] == "just text bold"
    paths = {r.host: r.path for r in pages.consensus_paths(given).collect()}
    assert paths["h.org"] == "/html/body/div.w#.wrap/div.b#.post-body"
    assert pages.extract_pages(given.limit(0)).count() == 0


def test_steps_are_generalised():
    assert pages.step_of("div", ["post-12", "b", "b"]) == "div.b.post-#"


def test_names_do_not_remove_the_article():
    long = "words of the article itself, one after the other. " * 9
    small = "<div class='sidebar'><p>Not this, though it is a sidebar.</p></div>"
    for page in (
        f"<html class='ad-free'><body class='no-sidebar header-fixed'><div><p>{long}</p></div>{small}</body></html>",
        f"<body><div class='content has-sidebar'><p>{long}</p>{small}</div></body>",
        f"<body><form id='aspnet'><div><p>{long}</p></div>{small}</form></body>",
        f"<body><main class='share'><p>{long}</p>{small}</main></body>",
    ):
        assert pages.main_text(page) == long.strip()
    # comments stay out, however long, where the page says what its article is
    assert pages.main_text(f"<body><article><p>{long}</p></article><div class='comments'><p>{long * 3}</p></div></body>") == long.strip()


def test_all_parts_of_an_article_are_read():
    long = "words of the article itself, one after the other. " * 9
    want = f"Head\nThe lead stands apart.\n{long.strip()}\nSaid by one."
    parts = f"<h1>Head</h1><div class='lead'>The lead stands apart.</div><div class='body'><p>{long}</p></div><blockquote>Said by one.</blockquote>"
    for page in (f"<body><article>{parts}</article></body>", f"<body><div><div class='post'>{parts}</div><div class='menu'>no</div></div></body>"):
        assert pages.main_text(page) == want
    quoted = f"<body><div class='x'><p>Before it.</p><blockquote>{long}</blockquote></div></body>"
    assert pages.main_text(quoted) == f"Before it.\n{long.strip()}"
    # the host's path holds under half of what this page's own path does
    other = f"<body><div class='a'><p>{long}</p></div><div class='b'><p>{long * 2}</p></div></body>"
    assert pages.main_text(other, "/body/div.a") == (long * 2).strip()


def test_formulas_and_fallbacks_are_text():
    page = "<body><article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p><object data='x'><p>Not shown?</p></object></article></body>"
    assert pages.main_text(page) == "Energy is E=m here.\nNot shown?"


def test_repeated_pages_and_a_table_of_many_hosts(spark, monkeypatch):
    rows = [(i % 3, f"http://h{i % 3}.org/", f"<body><div class='a'><p>{'text ' * 20}{i % 3}</p></div><nav>no</nav></body>") for i in range(9)]
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((i % 3, ("text " * 20) + str(i % 3)) for i in range(9))
    for hosts in (pages.HOSTS, 0):  # broadcast, and shuffled
        monkeypatch.setattr(pages, "HOSTS", hosts)
        assert sorted((r.page_id, r.text) for r in pages.extract_pages(given).collect()) == want


def test_noise_is_tracked_at_any_depth():
    deep = "<div>" * 400
    page = f"<body>{deep}<p>kept text that is long enough</p><div class='ad'><div>dropped</div></div><nav>dropped</nav><p>kept too</p>{'</div>' * 400}</body>"
    assert pages.main_text(page) == "kept text that is long enough\nkept too"


@pytest.mark.parametrize("unit", ["<a", '<a "', "<a '", "<!", "&", "</", "<p x='", '<a b="c"', "<script>", "<!--"])
def test_unclosed_markup_takes_linear_time(unit):
    began = time.perf_counter()
    assert pages.main_text("<p>words before</p>" + unit * (1_000_000 // len(unit))).startswith("words before")
    assert time.perf_counter() - began < 5
