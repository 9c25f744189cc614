"""What the template does for the text, and what pages and names may not do to it."""

from platelens.llm.html_extract import deduce_templates, extract_text, page_text

PAGES = "page_id long, url string, html string, slot long, host string"
NOTICE = "This notice stands on every page of the site and is longer than most of its stories are. " * 3


def site(n, host="s.example"):
    body = "<body><div id=a>{notice}</div><div id=b><h2>Story {k}</h2><p>{text}</p><p>Share this with all your friends now</p></div><div id=z>{notice}</div></body>"
    words = ["amber", "birch", "cedar", "dune", "ember", "fjord", "grove"]
    return [(k, f"http://{host}/{k}", body.format(notice=NOTICE, k=k, text=" ".join(words[(k * j) % 7] for j in range(1, 20))), 1, "x") for k in range(n)]


def test_text_depends_on_the_template(spark):
    rows = site(8)
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k, _, html, _, _ in rows:
        story = html.partition("<p>")[2].partition("</p>")[0]
        assert got[k] == f"Story {k} {story}"  # neither the notices nor the line that all stories end with
        assert "notice" in page_text(html, None)  # without the template the notices have most of the text
    found = deduce_templates(spark.createDataFrame(rows, PAGES)).collect()
    assert [(r.host, r.slot, len(r.runs)) for r in found] == [("s.example", "#page>body>div.b", 2)]


def test_repeated_rows_keep_the_templates(spark):
    once = spark.createDataFrame(site(8) + site(3, "t.example") + site(2, "u.example"), PAGES)
    a, b = ({(r.host, r.slot, tuple(r.runs)) for r in deduce_templates(x).collect()} for x in (once, once.unionByName(once)))
    assert a == b and {h for h, _, _ in a} == {"s.example", "t.example"}
    texts = lambda x: {(r.page_id, r.url, r.text) for r in extract_text(x).collect()}
    assert texts(once) == texts(once.unionByName(once))


def test_names_of_the_article_itself_are_no_noise():
    for opening in ('<article class="page-menu-open">', '<article id="form">'):
        assert page_text(f"<body><nav>n</nav>{opening}<h1>Head</h1><p>A text.</p></article><div class=ad>buy</div></body>", None) == "Head A text."
    assert page_text('<body><div class="story form-factor"><h1>Head</h1><p>A text.</p><div class="comments">no</div></div></body>', None) == "Head A text."
    many = "".join(f"<div class='a b c d{k} promo'>buy</div>" for k in "xyz")
    assert page_text(f"<body><article><p>one</p>{many}<p>two</p></article></body>", None) == "one two"


def test_very_long_and_odd_pages(spark):
    long = "<article>" + "<p>word &amp here</p>" * 100_000 + "</article>"
    rows = [(1, "http://l.example/", long, 1, "x"), (2, None, None, 1, "x"), (None, None, "<p>\ud83d\ude00 a", 1, "x")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == " ".join(["word & here"] * 100_000) and got[2] == "" and got[None].endswith(" a")


def test_prose_stays_whatever_it_is_called(spark):
    page = '<html><body><div class="nav"><a href="/">Home</a></div><article><h1>T{k}</h1><p class="reader">To the reader {k}.</p><p>The <span class="ad">best{k}</span> of <b class="search-hit">it {k}</b>.<span class="ad">buy now</span></p><ul class="menu"><li>m{k}</li></ul><div class="comments"><p>nice {k}</p></div></article></body></html>'
    rows = [(k, "http://x.example/p", page.replace("{k}", str(k))) for k in range(8)] + [(90, "http://lone.example/p", page.replace("{k}", "9"))]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 To the reader 3. The best3 of it 3."
    assert got[90] == "T9 To the reader 9. The best9 of it 9.buy now"
