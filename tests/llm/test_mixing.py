import pytest
from pyspark.sql import functions as F

from prematch.llm.mixing import budgets, mix

def _levels():
    return {name: F.col(name) for name in ("domain", "lang", "source")}


def _budgets(spark, leaves, share, epochs, weights=None):
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    out = budgets(df, ("domain", "lang", "source"), weights or {}, share=share, max_epochs=epochs)
    return {(r.domain, r.lang, r.source): r.budget for r in out.collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    got = _budgets(spark, leaves, (400, 3010), 1)
    # domains 200 each; in a languages 100 each; s1 has only 10, so its sibling s2 gets 90 and s3 stays at 100.
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s3"): 100, ("b", "en", "s4"): 200}


def test_a_whole_subtree_short_passes_on_to_its_ancestor(spark):
    leaves = [("a", "en", "s1", 10), ("a", "de", "s2", 500), ("b", "en", "s3", 1000)]
    assert _budgets(spark, leaves, (1000, 1510), 1) == {("a", "en", "s1"): 10, ("a", "de", "s2"): 490, ("b", "en", "s3"): 500}


def test_weights_and_exact_sums(spark):
    leaves = [(d, lang, f"{d}{lang}{i}", 97 * (i + 1)) for d in "ab" for lang in ("en", "de", "fr") for i in range(5)]
    total = sum(r[3] for r in leaves)
    got = _budgets(spark, leaves, (1, 3), 2, {"domain": {"a": 3}, "lang": {"en": 5}})
    assert sum(got.values()) == total // 3
    assert all(got[r[:3]] <= 2 * r[3] for r in leaves)


def test_budgets_of_very_large_corpora(spark):
    leaves = spark.createDataFrame([("a", 10**16), ("b", 10**16), ("c", 5 * 10**15)], "x string, tokens long")
    got = {r.x: r.budget for r in budgets(leaves, ["x"], {"x": {"a": 10**6, "b": 3 * 10**6}}, share=(1, 2), max_epochs=4, default_weight=10**6).collect()}
    assert sum(got.values()) == 125 * 10**14 and abs(got["b"] - 3 * got["a"]) <= 3 and abs(got["a"] - got["c"]) <= 1


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        _budgets(spark, [("a", "b", "c", 1)], (1, 1), 1, {"lang": {"x": 0}})


def _docs():
    rows = [(i, "w " * (i % 7), "d", "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 5}") for i in range(200)]
    rows += [(None, "no id here", "d", None, None), (5, "same id", "d", "en", "hot"), (7, None, "d", "en", "hot"), rows[11], rows[11]]
    return rows


def test_prefixes_meet_the_budgets(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in _docs()], "doc_id long, text string, domain string, lang string, source string, at int, cut int")
    rows = mix(df, levels=_levels(), share=(3, 2), max_epochs=3, seed=4).collect()
    assert rows
    total, budget = {}, {}
    for r in rows:
        leaf = (r.domain, r.lang, r.source)
        total[leaf] = total.get(leaf, 0) + r.n_taken
        budget[leaf] = r.leaf_budget
        assert 0 < r.n_taken <= r.n_tokens
    assert total == budget
    cut = [r for r in rows if r.n_taken < r.n_tokens]
    assert len({(r.domain, r.lang, r.source) for r in cut}) == len(cut)
    again = mix(df.repartition(7), levels=_levels(), share=(3, 2), max_epochs=3, seed=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, domain string, lang string, source string")
    assert mix(df, levels=_levels()).count() == 0
