import time

import pytest

from scorebook.llm import html


def page(k, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>"
        f"<div class='top'><p>Daily News</p><p>Today only</p></div><nav><ul><li>Home<li>About</ul></nav>"
        f"<div class='box'><h1>Head {k}</h1>{body}<p>Share this page with your friends</p></div>{extra}"
        f"<div class=sidebar>side {k}</div><footer>&copy; {k}</footer></body></html>"
    )


@pytest.mark.parametrize("markup, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<br>b <i>c</i>d<p>e", "a b cd e"),
    ("<article><h1>H</h1><p>x&nbsp; y\n z</p><!-- c --><ul><li>1<li>2</ul></article><p>other</p>", "H x y z 1 2"),
    ("<article>one<script>if (a<b) '</p>'</script> two<div class='comments'>no</div></article>", "one two"),
    ("<main><p>keep</p><form>no<input></form><aside>no</aside><div hidden>no</div></main>", "keep"),
    ("<article><header><p>by me</p><h1>Title</h1></header><p>t</p></article>", "Title t"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("<article><p>cut off <b>here</b> <a hre", "cut off here"), ("<article>5 &lt; 6 &#233; &unknown; &amp", "5 < 6 é &unknown; &"),
    ("<article><p>" + "<b>" * 3000 + "deep", "deep"), ("<p title=\"a>b\">q</p>", "q"),
])
def test_one_page(markup, text):
    assert html.extract(markup, {}) == text


def test_tree_matching():
    a = html.parse("<div><p>1</p><p>2</p><ul><li>x</ul></div>")
    b = html.parse("<div><p>1</p><h2>t</h2><p>3</p><p>4</p><ul><li>x<li>y</ul></div>")
    pairs = []
    assert html.match(a, b, pairs) == 6 == len(pairs)  # root, div, two p, ul, one li
    assert all(x.signature == y.signature for x, y in pairs)


def test_wrapper_tells_template_from_slots():
    pages = [page(k, f"<p>Story {k} says {k * k} things that differ a lot.</p><p>More of {k}.</p>") for k in range(8)]
    wrapper = html.induce(pages)
    assert wrapper["path"].endswith("div.box")
    assert html.extract(page(99, "<p>New story.</p><p>Rest.</p>"), wrapper) == "Head 99 New story. Rest."
    # A paragraph that only some pages share is no template.
    shared = [page(k, f"<p>{'Same licence' if k % 2 else f'Own {k} words here'}</p><p>Story {k} " + "long " * 30 + "</p>") for k in range(8)]
    assert "Same licence" in html.extract(shared[1], html.induce(shared))


def test_copies_of_one_page_keep_their_text():
    same = [page(1, "<article><p>Only text.</p></article>")] * 6
    assert html.extract(same[0], html.induce(same)) == "Only text."


def test_pages(spark):
    body = "<article><h1>H{0}</h1><p>Text {0} &amp; more.</p></article>"
    rows = [(k, f"http://hot.example.org/{k}", page(k, body.format(k)), "x") for k in range(60)]
    rows += [(100, None, None, "x"), (101, "", "", "x"), (102, "http://one.example.org/a", "<p>alone<p>here", "x"), (103, None, rows[0][2], "x"),
             (0, rows[0][1], rows[0][2], "x"), (105, "http://long.example.org", "<p>" + "word " * 60_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    found = {r.page_id: r for r in html.main_text(pages).collect()}
    assert html.main_text(pages).count() == len(rows)
    assert found[7].text == "H7 Text 7 & more." and found[7].n_chars == 17 and found[7].url == rows[7][1]
    assert (found[100].text, found[101].text, found[102].text) == ("", "", "alone here")
    assert found[103].text == "H0 Text 0 & more." and found[105].n_chars == 299_999
    assert html.main_text(pages.limit(0)).count() == 0


def test_deep_pages_are_matched():
    deep = [f"<div><p>Top</p>{'<div>' * 1000}<p>Story {k} told at length</p>" for k in range(5)]
    assert html.extract(deep[2], html.induce(deep)) == "Story 2 told at length"


def test_near_copies_of_an_article_are_no_template():
    body = "".join(f"<p>Paragraph {n} of the one article, with words of its own.</p>" for n in range(6))
    copies = [page(7, f"<p>Read {k} times</p>{body}") for k in range(12)]
    for article in ("{}", "<article>{}</article>"):
        same = [page(7, article.format(f"<p>Read {k} times</p>{body}")) for k in range(12)]
        found = html.extract(same[3], html.induce(same))
        assert all(f"Paragraph {n} of" in found for n in range(6))
    # Other pages of the host still show its template.
    others = [page(k, f"<p>Story {k} says {k * k} things that differ a lot.</p><p>More of {k}.</p>") for k in range(20, 26)]
    found = html.extract(copies[3], html.induce(copies + others))
    assert all(f"Paragraph {n} of" in found for n in range(6)) and "Share this" not in found


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content search-result", "post social-share-enabled"])
def test_mark_words_inside_names_drop_no_content(name):
    def made(k):
        return (
            f"<body><div class='{name}'><div class=text><h1>Head {k}</h1><p>Story {k} says {k * k} things that differ.</p></div>"
            f"<div class='left-sidebar'>see {k}</div><div class=sidebar>side {k}</div></div><div class='ad'>Buy {k} now</div></body>"
        )

    pages = [made(k) for k in range(8)]
    assert html.extract(pages[3], {}) == html.extract(pages[3], html.induce(pages)) == "Head 3 Story 3 says 9 things that differ."


@pytest.mark.parametrize("attribute", [
    "class='comment-list'", "id='comments-section'", "class='left-sidebar'", "class='reader-comments'", "id=commentsArea",
])
@pytest.mark.parametrize("tag", ["div", "article"])
def test_long_threads_and_sidebars_do_not_replace_the_article(attribute, tag):
    def made(k):
        thread = "".join(f"<p>Reader {k}{n} wrote {n * k} words about this and that.</p>" for n in range(30))
        inside, behind = (thread, "") if tag == "article" else ("", thread)
        return (
            f"<body><{tag} class=post><h2>Head {k}</h2><p>Story {k} says {k * k} things.</p>"
            f"{f'<section {attribute}>{inside}</section>' if inside else ''}</{tag}><section {attribute}>{behind}</section></body>"
        )

    pages = [made(k) for k in range(8)]
    expected = "Head 3 Story 3 says 9 things."
    assert html.extract(pages[3], {}) == expected
    assert html.extract(pages[3], html.induce(pages)) == expected


@pytest.mark.parametrize("markup, text", [
    ("<p><a href=\"x>link</a> and more", "link and more"), ("<p>a <b class='x>b</b> c", "a b c"),
    ("<p>1 < 2 and 3 > 2, a<b", "1 < 2 and 3 > 2, a"), ("<p>x<!-- never closed <p>y", "x"), ("<p>x<!doctype", "x"),
    (f"<p>x<img src=\"data:{'A' * 10_000}\">y", "xy"), ("<p>x<a title=\"a>b\" href=\"c\">y", "xy"),
])
def test_broken_tags_are_no_text(markup, text):
    assert html.extract(markup, {}) == text


@pytest.mark.parametrize("piece", ["<div class=\"x", "<a href='y>z", "<", "<!", "<p title=\"a'>"])
def test_broken_tags_take_linear_time(piece):
    start = time.monotonic()
    html.parse(piece * 100_000)
    assert time.monotonic() - start < 20


def test_repeated_rows(spark):
    body = "<article><h1>H{0}</h1><p>Text {0} &amp; more.</p></article>"
    rows = [(k % 3, f"http://rep.example.org/{k % 3}", page(k % 3, body.format(k % 3))) for k in range(300)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 300 and all(r.text == f"H{r.page_id} Text {r.page_id} & more." for r in found)
