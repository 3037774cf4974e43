import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import mixing as m

TARGETS = "source string, weight double, max_repeats int, lang string"


def mix(spark, docs, targets, **k):
    d = spark.createDataFrame([(i, t, lang, s, 7) for i, (t, lang, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, n_tokens int")
    return m.mixture(d, spark.createDataFrame([(*t, "x") for t in targets], TARGETS), **k)


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1e6), st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1e5)), max_size=8))
def test_shares_never_pass_a_capacity_and_use_what_there_is(budget, children):
    w, c = [x for x, _ in children], [y for _, y in children]
    got = m.share_out(budget, w, c)
    open_ = sum(y for x, y in children if x > 0)
    assert all(g <= y * (1 + 1e-9) + 1e-6 for g, y in zip(got, c))
    assert sum(got) == pytest.approx(min(budget, open_), rel=1e-6, abs=1e-3)


def test_siblings_take_a_shortage_before_ancestors():
    leaves = [
        {"domain": "a", "source": "x", "language": "en", "weight": 0.25, "capacity": 10.0}, {"domain": "a", "source": "y", "language": "en", "weight": 0.25, "capacity": 1000.0},
        {"domain": "b", "source": "z", "language": "en", "weight": 0.5, "capacity": 1000.0},
    ]
    assert m.tree_budgets(leaves, 100.0) == pytest.approx([10.0, 40.0, 50.0])


def test_weights_are_met_and_repeats_are_capped(spark):
    docs = [("a bridge is closed until Monday", "en", "big")] * 900 + [("the toll rises again", "en", "small")] * 40 + [("mehr wissen wir nicht", "de", "small")] * 20
    docs += [(None, "en", "small"), ("", "en", "big"), ("text", "en", None), ("text", None, "other")]
    rows, shares = mix(spark, docs, [("big", 0.8, 1), ("small", 0.2, 3), ("gone", 0.0, 2)], total=3000)
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].share == 0 and got["small"].most_copies <= 3 and got["big"].most_copies == 1
    assert got["big"].share == pytest.approx(0.8, abs=0.02) and got["small"].share == pytest.approx(0.2, abs=0.02)
    held = rows.collect()
    assert len({r.doc_id for r in held}) == len(held) and all(r.n_tokens > 0 for r in held)
    assert sum(r.n_tokens * r.copies for r in held) <= 3000


def test_unreachable_targets_and_seeds(spark):
    docs = [("one two three four", "en", "s")] * 50 + [("one two three four", "en", "t")] * 5
    rows, shares = mix(spark, docs, [("s", 0.5, 1), ("t", 0.5, 2)], total=10**6)
    assert {r.source: r.n_tokens for r in shares.collect()} == {"s": 200, "t": 40}
    pick = lambda seed: sorted(r.doc_id for r in mix(spark, docs, [("s", 1.0, 1)], total=100, seed=seed)[0].collect())
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 25


def test_empty_table(spark):
    rows, shares = mix(spark, [], [("s", 1.0, 1)])
    assert rows.count() == 0 and shares.first().share == 0


def test_default_total_meets_every_share_that_can_be_met(spark):
    docs = [("a bridge is closed until Monday", "en", "big")] * 4000 + [("mehr wissen wir nicht", "de", "big")] * 2000 + [("the toll rises", "en", "mid")] * 900 + [("der Zoll steigt", "de", "mid")] * 500
    _, shares = mix(spark, docs, [("big", 0.45, 1), ("mid", 0.45, 2), ("gone", 0.1, 2)])
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].share == 0 and not got["gone"].reached
    assert got["big"].share == pytest.approx(0.5, abs=0.01) and got["mid"].share == pytest.approx(0.5, abs=0.01)
    assert got["mid"].most_copies == 2


def test_a_source_without_documents_leaves_its_weight_to_its_siblings():
    leaf = lambda language, source, weight, capacity: {"domain": "c", "language": language, "source": source, "weight": weight, "capacity": capacity}
    leaves = [leaf("en", "x", 0.3, 1e9), leaf("en", "gone", 0.3, 0.0), leaf("de", "x", 0.4, 1e9)]
    assert m.tree_budgets(leaves, 100.0) == pytest.approx([60.0, 0.0, 40.0])
    assert m.reachable_total([leaf("en", "x", 0.5, 10.0), leaf("en", "y", 0.5, 100.0)]) == pytest.approx(20.0)
    assert m.reachable_total([]) == 0
