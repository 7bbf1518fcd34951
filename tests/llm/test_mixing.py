"""Weights, budgets and block permutations."""

import math
from collections import Counter

import pytest

from cardmill.llm import mixing as M


def source(name, tokens, target, most):
    return M.Source(name, tokens, target, most)


def test_feasible_mix_has_the_targets():
    sources = [source("a", 1000, 0.5, 2), source("b", 100, 0.3, 4), source("c", 0, 0.2, 4)]
    exponent, total, weights = M.solve(sources)
    assert exponent == 1 and weights == pytest.approx([0.625, 0.375, 0])
    assert total == pytest.approx(4 * 100 / 0.375)


def test_larger_total_gives_way_to_the_limits():
    sources = [source("a", 1000, 0.2, 3), source("b", 100, 0.8, 2)]
    exponent, total, weights = M.solve(sources, 1100)
    assert 0 < exponent < 1 and total == 1100 and sum(weights) == pytest.approx(1)
    assert weights[1] * 1100 <= 200 * 1.0001 and weights[1] * 1100 == pytest.approx(200, rel=1e-3)
    assert M.solve(sources, 1e9)[1] == 3200


def test_temperature_meets_the_entropy():
    sources = [source("a", 1000, 0, 1), source("b", 100, 0, 1), source("c", 10, 0, 1)]
    low, high = M.entropy([0.9, 0.09, 0.01]), math.log(3)
    for wanted in (low * 1.2, (low + high) / 2, high * 0.99):
        exponent = M.temperature(sources, wanted)
        assert M.entropy(M.tempered(sources, exponent, targets=False)) == pytest.approx(wanted, rel=1e-6)


def test_mix_in_spark(spark):
    rows = [(n, "big", 10) for n in range(2000)] + [(5000 + n, "small", 10) for n in range(20)] + [(9000, None, 10), (9001, "other", 10), (9002, "small", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    sources = [source("big", 20000, 0.5, 1), source("gone", 0, 0.1, 2), source("small", 200, 0.4, 8)]
    made = M.mix(spark, sizes, sources).collect()
    uses = Counter(r.doc_id for r in made)
    tokens = Counter()
    for r in made:
        tokens[r.source] += r.n_tokens
    assert tokens["small"] == 1600 and abs(tokens["big"] - 2000) <= 10 and set(tokens) == {"big", "small"}
    assert max(n for d, n in uses.items() if d >= 5000) == 8 and max(n for d, n in uses.items() if d < 5000) == 1
    assert all(0 <= r.mix_key <= 1 for r in made)
    early = [r for r in made if r.mix_key < 0.5]
    assert 0.35 < sum(r.source == "small" for r in early) / len(early) < 0.55
    again = M.mix(spark, sizes.repartition(7), sources).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, made))
    whole = M.uses(spark, sizes, sources)
    assert whole.count() == len(rows) and whole.where("doc_id = 9001").first().uses == 0
    report = {r.source: r for r in M.shares(spark, M.mix(spark, sizes, sources), sources).collect()}
    assert report["gone"].share == 0 and report["small"].most_repeats == 8


def test_nothing_to_mix(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    sources = [source("a", 0, 1.0, 2)]
    assert M.mix(spark, sizes, sources).count() == 0
    assert M.shares(spark, M.mix(spark, sizes, sources), sources).first().tokens == 0


def test_sources_are_tidied(spark):
    docs = spark.createDataFrame([(1, "a b", " Big_Site "), (2, None, "big-site"), (3, "c", None), (4, "", " ")], "doc_id bigint, text string, source string")
    sizes = {r.doc_id: (r.source, r.n_tokens) for r in M.source_sizes(docs).collect()}
    assert sizes == {1: ("big-site", 2), 2: ("big-site", 0), 3: (None, 1), 4: (None, 0)}
