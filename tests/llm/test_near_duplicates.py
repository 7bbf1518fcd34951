"""Near-equal records against all pairs compared, with copies and odd rows."""

import random

import numpy as np
import pytest

from cardmill.llm import near_duplicates as N


def brute(rows, threshold):
    import re

    sets = {i: frozenset(re.findall(r"[^\W_]+", " ".join(t for t in texts if t).lower())) for i, *texts in rows if i is not None}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def corpus(seed, n, vocabulary, words):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)]
    weights = [1 / (k + 1) for k in range(vocabulary)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 5)):
                where = rng.randrange(len(text))
                text[where : where + rng.randrange(2)] = rng.choices(vocab, weights, k=rng.randrange(2)) or []
                text = text or ["w0"]
            rng.shuffle(text)
        else:
            text = rng.choices(vocab, weights, k=rng.randrange(1, words))
        rows.append((f"r{k:04d}", " ".join(text), rng.choice(["", None, "Tail, tail!"])))
    return rows


@pytest.mark.parametrize(("seed", "threshold", "words"), [(1, 0.7, 40), (2, 0.8, 12), (3, 0.7, 6)])
def test_equals_all_pairs(spark, seed, threshold, words):
    rows = corpus(seed, 350, 300, words)
    data = spark.createDataFrame([(*r, "clash") for r in rows], "card_id string, front string, back string, words string")
    sets = N.record_sets(data, "card_id", "front", "back")
    found = {(r.id_a, r.id_b) for r in N.near_pairs(sets, threshold).collect()}
    wanted = brute(rows, threshold)
    assert found == wanted


@pytest.mark.parametrize("long_list", [2, 12])
def test_long_lists_are_split_without_loss(spark, long_list):
    rows = corpus(5, 300, 60, 30)
    sets = N.record_sets(spark.createDataFrame(rows, "card_id string, front string, back string"), "card_id", "front", "back")
    whole = {tuple(r)[:2] for r in N.class_pairs(sets).collect()}
    assert whole and {tuple(r)[:2] for r in N.class_pairs(sets, long_list=long_list).collect()} == whole


def test_no_pair_is_lost_whatever_the_rare_words():
    rng = np.random.default_rng(1)
    common = np.sort(rng.choice(1 << 40, 400, replace=False))
    counts = rng.integers(3000, 9000, 400)
    for _ in range(600):
        n = int(rng.integers(3, 200))
        shared = rng.choice(common, n, replace=False)
        own = int(0.3 / 0.7 * n + 1e-9)  # words that only one of both has, all rarer than the shared ones
        left = int(rng.integers(0, own + 1))
        a, b = (np.sort(np.concatenate((shared, rng.choice(1 << 40, k) + (1 << 41)))) for k in (left, own - left))
        keys = [set(N.list_keys(s, np.array([len(s)]), N.Words(common, counts, 10_000), 0.7)[1]) for s in (a, b)]
        assert keys[0] & keys[1], (n, left, own)


def test_many_copies_are_one_class(spark):
    rows = [(f"c{k}", "one two three four five", None) for k in range(300)] + [("x", "one two three four five six", None), ("x", "one two three four five six", None), (None, "one two", None), ("e", "", None), ("n", None, None)]
    sets = N.record_sets(spark.createDataFrame(rows, "card_id string, front string, back string"), "card_id", "front", "back")
    groups = {r.id: r for r in N.near_groups(sets).collect()}
    assert len(groups) == 301 and groups["c7"].n_copies == 300 and groups["c7"].n_links == 1 and groups["x"].n_links == 1
    assert groups["x"].group_id == groups["c0"].group_id and groups["x"].class_id != groups["c0"].class_id


def test_chains_are_one_group(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a bigint, b bigint")
    groups = {r["node"]: r["group"] for r in N.components(links).collect()}
    assert {groups[k] for k in range(61)} == {0} and groups[101] == 100


def test_groups_that_still_change_are_not_returned(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        N.components(links, most_rounds=2)


def test_empty(spark):
    sets = N.record_sets(spark.createDataFrame([], "card_id string, front string, back string"), "card_id", "front", "back")
    assert N.near_pairs(sets).count() == 0 and N.near_groups(sets).count() == 0


def test_keys_of_one_set_are_shared_by_its_copy_without_some_words():
    rng = np.random.default_rng(0)
    common = np.sort(rng.integers(0, 1 << 40, 50))
    counts = rng.integers(200, 5000, 50)
    base = np.sort(rng.choice(common, 30, replace=False))
    for lost in range(4):
        other = np.sort(np.delete(base, rng.choice(30, lost, replace=False)))
        keys = [set(N.list_keys(s, np.array([len(s)]), N.Words(common, counts, 10_000), 0.7)[1]) for s in (base, other)]
        assert keys[0] & keys[1]
