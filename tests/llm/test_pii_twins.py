from platelens.llm.pii import find_pii


def test_twins_are_found_at_any_distance(spark):
    text = "call +1 (017) 555-7713 or later (017) 555-7713 and not 12 or 99 beans"
    far = "call +1 (017) 555-7713 now. " + " ".join(f"Then {k + 10} more beans, 555-7713 again." for k in range(20))
    late = "ask 555-7713 first, 12 beans later +1 (017) 555-7713"
    rows = [(i, text.replace("555", f"{500 + i}")) for i in range(40)] + [(50, far), (51, late), (52, "call 555-7713 or 12 beans")]
    got = {r.doc_id: r.spans.split(",") for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_sample=60).collect()}
    for i, t in rows[:40]:
        at = t.rindex(f"{500 + i}-7713")
        assert got[i] == ["phone:5:22", f"phone:{at}:{at + 8}"]
    ats = [k for k in range(len(far)) if far.startswith("555-7713", k)]
    assert len(ats) == 21 and [s for s in got[50] if s != "phone:5:22"] == [f"phone:{k}:{k + 8}" for k in ats[1:]]
    assert "phone:4:12" in got[51]
