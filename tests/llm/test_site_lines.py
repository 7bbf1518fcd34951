import random
from itertools import combinations

import pytest

from cardmill.llm import site_lines as L

FIELDS = "doc_id string, chunk_pos int, text string, source string, site string"


def chunks(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], FIELDS)


def found(data, **how):
    return {(r.doc_id, r.chunk_pos, r.line_no) for r in L.repeated_lines(data, **how).collect()}


def test_lines_of_three_files(spark):
    rows = [(f"d{k}", 0, f"Own line {chr(97 + k)}\nCopyright {2000 + k}, March!\n\n12", "site/a.md") for k in range(3)]
    rows += [("e", 0, "copyright", "other/a.md"), ("f", 0, "Copyright", "site/b.pdf p.3"), ("g", 0, None, "site/c.md"), ("h", 0, "Copyright", None)]
    data = chunks(spark, rows + rows)
    assert found(data) == {(f"d{k}", 0, 2) for k in range(3)}
    assert found(data, min_files=4) == set()


def test_share_of_files_and_whole_words(spark):
    rows = [(f"d{k}", 0, f"text {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}", "s/x") for k in range(97)] + [(f"m{k}", 0, "Maybe", "s/x") for k in range(3)]
    assert found(chunks(spark, rows)) == set()
    assert found(chunks(spark, rows), min_share=0.03) == {(f"m{k}", 0, 1) for k in range(3)}
    marked = [(f"d{k}", 0, f"{m} notes", "s/x") for k, m in enumerate(["May", "June", "maybe", "(July)"])]
    assert found(chunks(spark, marked)) == {("d0", 0, 1), ("d1", 0, 1), ("d3", 0, 1)}


def sequences(data, **how):
    return L.frequent_sequences(L.prepared_lines(data), L.site_files(data), **how).collect()


def test_sequences_and_clean_texts(spark):
    rows = [(f"d{k}", 0, f"Share this\nmy own {'abc'[k]}\nAll rights", "s/x") for k in range(3)] + [("z", 1, None, None), ("z", 2, "", "s/x")]
    made = sorted((len(r.sequence), r.support) for r in sequences(chunks(spark, rows)))
    assert made == [(1, 3), (2, 3)]  # from each of the two lines on
    texts = {(r.doc_id, r.chunk_pos): r.text for r in L.without_repeated_lines(chunks(spark, rows)).collect()}
    assert texts == {("d0", 0): "my own a", ("d1", 0): "my own b", ("d2", 0): "my own c", ("z", 1): None, ("z", 2): ""}


def test_sequences_with_gaps_across_chunks_of_any_length(spark):
    order = "alpha beta gamma delta epsilon zeta".split()
    rows = [(f"d{k}", pos, "\n".join(order[3 * pos : 3 * pos + 3]), "s/x") for k in range(3) for pos in (1, 0)]
    rows += [(f"e{k}", 0, f"alpha\n{'kappa' if k % 2 else 'gamma'}\nzeta", "s/x") for k in range(3)] + [(None, 0, "zeta\nalpha", "s/x")] * 3
    made = [(len(r.sequence), r.support) for r in sequences(chunks(spark, rows + rows))]
    # all six lines from each on, alpha-zeta in six files, alpha-gamma-zeta in five, and what begins with gamma or zeta in more
    assert sorted(made) == [(1, 6), (2, 3), (2, 5), (2, 6), (3, 3), (3, 5), (4, 3), (5, 3), (6, 3)]


def closed(rows, need):
    """Brute force: frequent subsequences that no longer one with the same first line and support contains."""
    support: dict[tuple, int] = {}
    for row in rows:
        for sub in {tuple(row[i] for i in picked) for n in range(1, len(row) + 1) for picked in combinations(range(len(row)), n)}:
            support[sub] = support.get(sub, 0) + 1
    inside = lambda a, b: all(x in it for it in [iter(b)] for x in a)
    often = {s: n for s, n in support.items() if n >= need}
    return {(s, n) for s, n in often.items() if not any(len(t) > len(s) and t[0] == s[0] and m == n and inside(s, t) for t, m in often.items())}


@pytest.mark.parametrize("seed", range(16))
def test_grown_sequences_equal_brute_force(seed):
    rng = random.Random(seed)
    rows = [rng.sample(range(8), rng.randrange(1, 8)) for _ in range(9)]
    wanted, made = closed(rows, 3), set()
    for first in {x for row in rows for x in row}:
        rests = [tuple(row[row.index(first) + 1 :]) for row in rows if first in row]
        if len(rests) >= 3:
            made |= {(tuple(s), n) for s, n in L.Projection(first, rests, [1] * len(rests)).grow(3)}
    assert made == wanted


def test_long_blocks_in_all_files_are_one_sequence():
    block = tuple(range(1, 60))
    assert list(L.Projection(0, [block] * 5, [1] * 5).grow(3)) == [([0, *block], 5)]


def test_empty(spark):
    assert found(chunks(spark, [])) == set() and len(sequences(chunks(spark, []))) == 0
