"""Operator 1."""

from html.parser import HTMLParser

from pyspark.sql import types as T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType())])


class Article(HTMLParser):
    """Plain reading of the test pages: paragraphs and heading of <article>."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []

    def flush(self):
        if t := " ".join("".join(self.now).split()):
            self.blocks.append(t)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1"):
            self.flush()
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_all_pages(spark, sf):
    from lookalike.llm.html_extract import op1_html_text

    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = Article()
        a.feed(r.html)
        a.flush()
        want[r.page_id] = "\n\n".join(a.blocks)
    got = op1_html_text(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def page(body, top="Home"):
    return f"<html><body><div class='top-bar'>{top}</div><div id=wrap><ul class=menu><li><a href=/>A</a><li><a href=/b>B</a></ul>{body}<div class='comments'><p>first!</p></div></div><FOOTER>me</FOOTER>"


def test_pages_without_article(spark):
    from lookalike.llm.html_extract import infer_wrappers, main_text

    story = "<div class=story><h2>T{0} &lt;b&gt;</h2><p>One {0} <i>two</i>\n three&nbsp;&eacute;<p>Four<br>five {0}{1}</div>"
    long = " and more words of the story" * 20
    rows = [(i, "https://H.example/x", page(story.format(i, long) + ("<div class=ad>Buy</div>" if i % 2 else "")), "h") for i in range(6)]
    rows += [(10, "https://h.example/y", None, None), (11, None, "", None), (12, "nonsense", "<p>only <b>text", None), (12, "nonsense", "<p>only <b>text", None)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = {(r.page_id): r.text for r in main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"T{i} <b>\n\nOne {i} two three é\n\nFour five {i}{long}"
    assert got[10] == got[11] == "" and got[12] == "only text"
    w = {r.host: r.expression for r in infer_wrappers(df).collect()}["h.example"]
    assert "<div.ad>(" in w and ")?" in w and "<p>(#text)+" in w
    assert main_text(df).count() == 10 and main_text(df.limit(0)).count() == 0


def test_alignment():
    from lookalike.llm.html_extract import align, blocks, regex_of, wrapper_of

    a, b = (wrapper_of(blocks(x)) for x in ("<div><h1>x</h1><p>same</p></div>", "<div><h1>y</h1><div class=ad>z</div><p>same</p><p>other</p></div>"))
    assert regex_of(align(a, b)) == '<div>(<h1>(#text) <div.ad>("z")? <p>(#text)+)'
    assert regex_of(align(a, a)) == '<div>(<h1>("x") <p>("same"))'


LEAKS = "ad-slot advert-box comment-list comments-area post-comments reader-comments site-footer related-posts share-buttons cookie-bar newsletter-signup promo-box sidebar-left sponsored-content adsbygoogle nav_top".split()


def test_class_names_inside_and_on_articles(spark):
    from lookalike.llm.html_extract import main_text

    lost = "legal search alert notice related side".split()
    words = " and many more words of the story" * 5
    rows = [(i, f"http://leak{i}.example/", f"<body class='has-sidebar'><article><p>Story {i}{words}</p><div class='{c}'><p>Noise</p></div><header><h1>Head</h1></header></article>", None) for i, c in enumerate(LEAKS)]
    rows += [(100 + i, f"http://lost{i}.example/", f"<article class={c}><p>Story {100 + i}{words}</p></article><div class={c}>x</div>", None) for i, c in enumerate(lost)]
    rows += [(200 + i, "http://side.example/", f"<div class='main-content with-sidebar'><div class=search-result><p>Story {200 + i}{words}</p></div></div><div class=sidebar>x</div>", None) for i in range(3)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Story {i}{words}" + ("\n\nHead" if i < 100 else "") for i, *_ in rows}


def test_unclosed_and_very_long(spark):
    from lookalike.llm.html_extract import main_text

    rows = [(i, f"http://u{i}.example/", f"<head><{tag}>t</head><body><article><p>Kept</p></article>", None) for i, tag in enumerate(("title", "noscript"))]
    rows += [(5, "http://long.example/", "<article>" + "<p>word</p>" * 100_000 + "</article>", None), (6, "http://deep.example/", "<div>" * 3000 + "deep" + "</div>" * 3000, None)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == got[1] == "Kept" and got[6] == "deep"
    assert got[5] == "\n\n".join(["word"] * 100_000)
