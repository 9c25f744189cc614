from platelens.llm.html_extract import extract_text, page_text


def test_deep_pages_keep_their_text(spark):
    deep = "<div>" * 400 + "deep<nav>menu</nav><div class='ad'>buy</div>" + "</div>" * 400
    page = f"<body><article><p>before</p>{deep}<p>behind</p></article><div>outside</div></body>"
    assert page_text(page, None) == "before deep behind"
    held = f"<body><div class='story'><p>a longer text before it</p>{deep}<p>and a longer text behind it</p></div><nav>n</nav></body>"
    assert page_text(held, "#page>body>div.story") == "a longer text before it deep and a longer text behind it"
    chain = "<body><article>" + "<font>x " * 700 + "<nav>menu</nav>" + "</font>" * 700 + "<p>behind</p></article><footer>f</footer></body>"
    assert page_text(chain, None) == "x " * 700 + "behind"
    rows = [(k, "http://a.example/", page) for k in range(4)]
    assert {r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"before deep behind"}
