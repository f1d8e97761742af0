"""Template deduction and extraction."""
import html as H
import re

from conftest import SF_SMALL

from vacanta.llm import html_template as X
from vacanta.llm import queries

PAGES = "page_id long, url string, html string, host string, text string, page string, roots string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "p", "r") for r in rows], PAGES)


def news(k, body=None):
    return (f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body class='n{k}'>"
            f"<header><h1>Site</h1></header><div class=menu><ul><li><a href=/>Home<li><a href=/x>X{k}</ul></div>"
            f"<div id=content><h2>Title {k}</h2>" + (body or f"<p>First &amp; text\n of  {k}.<p>Second <b>bold</b>&nbsp;part {k}"
                                                    f"<script>var a='<p>no</p>';</script>.<ul><li>one {k}<li>two {k}</ul>") +
            f"<aside>Side {k}</aside><form>Name <input name=q></form></div>"
            f"<div class='comments'><p>Reader says {k}</p></div><div>Powered by us</div><footer>c {k}</footer></body></html>")


def text_of(k):
    return f"Title {k}\nFirst & text of {k}.\nSecond bold part {k}.\none {k}\ntwo {k}"


def test_article_without_semantic_elements(spark):
    rows = [(k, f"http://a.example/{k}", news(k)) for k in range(8)]
    got = {r.page_id: r for r in X.extract(pages(spark, rows)).collect()}
    for k in range(8):
        assert got[k].text == text_of(k)
        assert got[k].n_chars == len(got[k].text) and got[k].url == f"http://a.example/{k}"


def test_template_text_needs_every_page(spark):
    body = "<p>Follow us</p><p>Own words of {} only</p><p>Only some</p>"
    rows = [(k, "http://b.example/", news(k, body.format(k) if k else body.format(k).replace("Only some", "other"))) for k in range(6)]
    got = {r.page_id: r.text for r in X.extract(pages(spark, rows)).collect()}
    assert got[3] == "Title 3\nOwn words of 3 only\nOnly some"  # what each page has once is template
    few = {r.page_id: r.text for r in X.extract(pages(spark, rows[:3])).collect()}
    assert "Follow us" in few[2]  # too few pages to tell


def test_copies_of_an_article_keep_their_text(spark):
    page = "<html><body><nav>m</nav><article><h1>A</h1><p>x y</p></article><footer>f</footer></body></html>"
    got = X.extract(pages(spark, [(k, "http://c.example/", page) for k in range(20)])).collect()
    assert [r.text for r in got] == ["A\nx y"] * 20


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "plain < text & more"), (None, "http://d/", "<p>a<p>b"),
            (4, "http://d/", "<p>a<p>b"), (4, "http://d/", "<p>a<p>b"), (5, "http://e/", "<article><p>never closed <b>bold"),
            (6, "http://e/", "<!-- open comment <p>x"), (7, "http://e/", "<script>open"), (8, "http://f/", "<div " * 3000),
            (9, "http://g/", "<article><p>" + "word " * 50_000 + "</p></article>"), (10, "http://g/", "<article>&#x41;&eacute;&lt;b&gt;</article>")]
    got = {}
    for r in X.extract(pages(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == got[2] == [""] and got[3] == ["plain < text & more"]
    assert got[4] == ["a\nb"] * 2 and got[None] == ["a\nb"]
    assert got[5] == ["never closed bold"] and got[6] == got[7] == [""] and got[8] == [""]
    assert got[9] == [("word " * 50_000).strip()] and got[10] == ["Aé<b>"]
    assert X.extract(pages(spark, rows[:1]).limit(0)).count() == 0


def test_deep_pages_keep_their_text():
    deep = "<div>" * 5000 + "<p>low</p>" + "</div>" * 5000 + "<p>after"
    assert X.main_text(deep, [], set()) == "low\nafter"


def test_furniture():
    assert X.furniture(("html", "body", "div[top-banner]")) and X.furniture(("html", "body", "nav"))
    assert X.furniture(("html", "body", "header")) and not X.furniture(("html", "article", "header"))
    assert X.furniture(("html", "article", "div[reader comments]"))
    assert not X.furniture(("html", "body", "div[shadow gradient]", "div[adapter]"))


def test_query_finds_the_articles(spark):
    """The test pages' articles are known: headings and paragraphs under article."""
    def article(page):
        own = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page)[1]
        blocks = (re.sub(r"\s+", " ", H.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>|<br><p>", own))
        return "\n".join(b for b in blocks if b)
    given = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = queries.queries()["op1_main_text"](spark, SF_SMALL).collect()
    assert {r.page_id: r.text for r in got} == given and len(got) == len(given)


def test_deep_elements_do_not_close_outer_ones():
    deep = "<body><div><article>a" + "<font>" * 400 + "<div>b</div>c<div>d</div>" + "</font>" * 400 + "<p>e</p></article>f</div>"
    assert X.main_text(deep, ["body/div/article"], set()) == "a\nb\nc\nd\ne"
    deeper = "<body><div><article>a" + "<span>" * 400 + "<p>x<div>y</div>z</article>f</div>"
    assert X.main_text(deeper, ["body/div/article"], set()) == "a\nx\ny\nz"


def test_headline_and_lead_beside_the_body_are_kept(spark):
    page = ("<html><body><div class=top><ul><li><a href='/'>Home {0}</a> | <li><a href=/x>News</a></ul></div><div class=wrap><h1>Title {0}</h1>"
            "<div class=lead>Lead of {0} here.</div><div class=body><p>" + "Words of page {0} go on. " * 20 + "</p><ul><li><a href=/s>Source {0}</a></ul></div>"
            "<div class=more><a href=/n>Next {0}</a></div></div><div>Made by us</div></body></html>")
    for n in (8, 3):
        got = {r.page_id: r.text for r in X.extract(pages(spark, [(k, "http://m.example/", page.format(k)) for k in range(n)])).collect()}
        for k in range(n):
            assert got[k] == f"Title {k}\nLead of {k} here.\n" + ("Words of page %d go on. " % k * 20).strip() + f"\nSource {k}"


def test_main_or_article_by_weight(spark):
    page = ("<html><body><main><div class=text><p>" + "Words of page {0} go on. " * 20 + "</p></div></main>"
            "<article class=card><p>Card {0}</p></article></body></html>")
    inside = page.replace("</main>", "").replace("</article>", "</article></main>")
    words = lambda k: ("Words of page %d go on. " % k * 20).strip()
    for given, more in ((page, ""), (inside, "\nCard {}")):
        got = {r.page_id: r.text for r in X.extract(pages(spark, [(k, "http://m.example/", given.format(k)) for k in range(6)])).collect()}
        assert got == {k: words(k) + more.format(k) for k in range(6)}
