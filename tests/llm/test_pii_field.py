"""What the field does: exact beliefs on small graphs, and spans that only clamped mentions bring about."""

import itertools

import numpy as np

from platelens.llm.pii import _BUCKETS, NONE, SkipChainCRF, find_pii, pattern_spans


def exact(node, edges, potentials):
    """Marginals by going through all labellings."""
    n, k = node.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        p = np.exp(sum(node[i, x] for i, x in enumerate(labels)) + sum(pot[labels[a], labels[b]] for pot, sort in zip(potentials, edges) for a, b in sort))
        for i, x in enumerate(labels):
            out[i, x] += p
    return out / out.sum(1, keepdims=True)


def test_beliefs_match_brute_force():
    rng = np.random.default_rng(5)
    k = NONE + 1
    for trees in (True, False):
        for _ in range(5):
            weights = rng.normal(0, 1, (_BUCKETS, k)) if trees else rng.normal(0, 0.5, (_BUCKETS, k))
            size = 1.5 if trees else 0.25
            potentials = [size * rng.normal(0, 1, (k, k)) for _ in range(3)]
            potentials = [(p + p.T) / 2 for p in potentials]
            edges = [[(0, 1), (1, 2)], [(1, 3)], [(3, 4)] if trees else [(3, 4), (4, 0)]]
            features, clamped = rng.integers(0, _BUCKETS, (5, 6)), np.array([-1, -1, 2, -1, -1])
            got = SkipChainCRF(weights, potentials).marginals(features, clamped, [np.array(e) for e in edges], np.zeros(5, np.int64))
            node = weights[features].sum(1)
            node[2] = -30.0
            node[2, 2] = 0.0
            want = exact(node, edges, potentials)
            assert np.abs(got - want).max() < (1e-3 if trees else 0.05)


def test_spans_need_a_clamped_mention(spark):
    card, fails = "4111 1111 1111 1111", "4111111111111112"
    rows = [(i, f"pay with 4{i:03d} now or {i} beans for order {i + 70000}") for i in range(40)]
    rows += [(100 + i, f"card {card} was used, order {5000000000000000 + 7 * i} was not") for i in range(40)]
    rows += [(200, f"see {fails} and then {fails} again"), (201, f"first {card} and then 4111.1111.1111.1111 again"), (202, f"{fails} {fails} {fails}")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string"), max_sample=200).collect()}
    assert got[200].spans == "" and got[202].spans == ""
    assert not pattern_spans("4111.1111.1111.1111")  # the patterns miss this spelling
    assert got[201].spans == "card:6:25,card:35:54" and got[201].n_card == 1
    assert all(got[i].spans == "" for i in range(40))


def test_address_parts_go_by_value():
    assert pattern_spans("0000000001.2.3.4") == [(1, 0, 16)]
    assert pattern_spans("0" * 5000 + ".0.0.255") == [(1, 0, 5008)]
    assert pattern_spans("0000000256.2.3.4") == [] and pattern_spans("1." + "9" * 5000 + ".3.4") == []
