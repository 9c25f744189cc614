import re

from platelens.llm.pii import KINDS, SkipChainCRF, Nodes, content, find_pii, luhn, pattern_spans, train_crf


def reference(text):
    """The contract's patterns, literally."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_patterns_match_the_contract(spark):
    texts = [
        "a@b.c@d.e x@y@z.org me.too+1@mail-1.example.com.",
        "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 00001.2.3.255 12345678901234567890.1.1.1",
        "4111 1111 1111 1111, 4111-1111-1111-1112 79927398713 +1 (017) 555-7713 then (017) 555-7713",
        "+49 30 1234567 +1 2", "é@x.de é1@x.de", "",
    ]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for text in texts + [r.text for r in docs.collect()]:
        assert [(KINDS[k], a, b) for k, a, b in pattern_spans(text)] == reference(text)


def test_twins_share_labels(spark):
    text = "call +1 (017) 555-7713 or later (017) 555-7713 and not 12 or 99 beans"
    rows = [(i, text.replace("555", f"{500 + i}")) for i in range(40)] + [(100, None), (101, ""), (101, ""), (None, "x 1.2.3.4")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_sample=50).collect()}
    assert len(got) == 43 and got[100].spans == "" and got[None].n_ip == 1
    assert got[3].n_phone == 1 and got[3].spans.startswith("phone:5:22")
    base = pattern_spans(rows[3][1])
    nodes = Nodes(rows[3][1], base)
    assert content("+1 (017) 555-7713") == content("555-7713")
    chain, twin, skip = nodes.edges()
    assert any({nodes.texts[a], nodes.texts[b]} == {"+1 (017) 503-7713", "503-7713"} for a, b in twin)
    assert all(s in got[3].spans for s in ("phone:5:22",))


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert isinstance(train_crf(spark.createDataFrame([(1, "no numbers")], "doc_id long, text string")), SkipChainCRF)
