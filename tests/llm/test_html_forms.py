"""Main text on common page forms, and on the given pages against a reading of
their marked-up article by the standard HTML parser."""

from html.parser import HTMLParser

import pytest

from marketlens.llm import html_main

HEAD = "<html><body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav>"
BODY = "<p>Some words of the article stand here for all to read.</p>"
WORDS = "Some words of the article stand here for all to read."


@pytest.fixture(scope="module")
def weights():
    import duckdb
    rows = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet' WHERE html IS NOT NULL").fetchall()
    return html_main.learn([r[0] for r in rows])


@pytest.mark.parametrize("inner, text", [
    ("<p><b>foo</b> <i>bar</i> of it</p>", "foo bar of it"),
    ("<p><a href=x>one</a> <a href=y>two</a>\n<em>three</em></p>", "one two three"),
    ("<p>first of them</p><svg-icon name=x></svg-icon><p>second of them</p>", "first of them\n\nsecond of them"),
    ("<p>an <svg viewBox='0 0 1 1'><title>no</title><svg><path d='M0'/></svg><text>no</text></svg> icon in a line</p>", "an icon in a line"),
    ("<p>the <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> formula</p>", "the x=2 formula"),
    ('<p>a <a title="x > y" href="u">link</a> in it</p>', "a link in it"),
    ("<p>a <a title=it's>link</a> that isn't cut</p>", "a link that isn't cut"),
    ('<p>a <a title="open>link</a> in it</p>', "a link in it"),
    ("<p>pick <select><option>a<option>b</select> one of them</p>", "pick one of them"),
])
def test_inside_the_article(weights, inner, text):
    page = f"{HEAD}<article>{inner}{BODY}</article><footer>foot of it</footer></body></html>"
    assert html_main.main_text(page, weights) == f"{text}\n\n{WORDS}"
    assert html_main.main_text(page, html_main.DEFAULT) == f"{text}\n\n{WORDS}"


@pytest.mark.parametrize("before", [
    "<video-js id=a></video-js>", "<datalist><option value='a'><option value='b'></datalist>", "<canvas id=c>no canvas", "<object data=x>",
    "<select><option>one<option>two", "<svg><path d='M0 0'/>", "<template-x>", "<div><canvas></div>", "<audio src=x>", "<script-x></script-x>"])
def test_before_the_article(weights, before):
    page = f"{HEAD}{before}<article>{BODY}</article></body></html>"
    assert html_main.main_text(page, weights) == WORDS


def test_comments_that_are_articles(weights):
    comments = "<section id=comments><article><p>reader says this and that about it all</p></article></section>"
    for label in ("main", "article"):
        assert html_main.main_text(f"{HEAD}<{label}>{BODY}{comments}</{label}></body></html>", weights) == WORDS
    # a wrapper of the whole is spared all the same
    assert html_main.main_text(f"{HEAD}<div class=overlay><article>{BODY}</article></div></body></html>", weights) == WORDS


def test_long_tags_end_soon():
    page = "<p " + "a='" * 50000 + ">" + "<a =" * 20000 + "x"
    html_main.main_text(page, html_main.DEFAULT)


class Article(HTMLParser):
    """Blocks of the text inside ``article``, without its parts that are no content."""

    SKIP = {"script", "style", "nav", "aside", "form", "footer", "button", "svg", "noscript", "iframe", "select", "textarea", "figure-x"}
    BLOCKS = html_main.BLOCK

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        named = any(k in ("class", "id", "role") and v and any(x in html_main.NOT_CONTENT for x in v.lower().split()) for k, v in attrs)
        if tag not in html_main.VOID and (self.skip or tag in self.SKIP or (self.depth and named)):
            self.skip.append(tag)
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if self.skip and tag in self.skip:
            while self.skip.pop() != tag:
                pass
        if tag == "article":
            self.depth -= 1
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def test_given_pages(spark):
    """All pages of the table that mark up their article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["id"]: r["text"] for r in html_main.extract_main(pages).collect()}
    same = n = 0
    for r in pages.collect():
        if "<article" in (r["html"] or ""):
            parser = Article()
            parser.feed(r["html"])
            want = "\n\n".join(x for b in parser.blocks if (x := " ".join(b.split())))
            n, same = n + 1, same + (got[r["page_id"]] == want)
    assert n > 200 and same / n > 0.97, (same, n)
