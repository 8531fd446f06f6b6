"""Prefix filtering in large groups: no similar pair is lost, template groups stay small, dealing links what is similar."""

import random

import numpy as np
import pytest

from siltstone.llm import _common, _prefixes, line_dedup


def hashed(members):
    return np.unique(_common.mix64(np.array(sorted(members), np.uint64))).tobytes()


def table(spark, rows):
    return spark.createDataFrame([(name, node, hashed(s)) for name, node, s in rows], "name long, node long, hashes binary")


@pytest.mark.parametrize("tenths", [8, 9, 5])
def test_no_similar_pair_is_lost(spark, tenths):
    random.seed(41)
    sets = []
    for _ in range(30):
        base = random.sample(range(2000), random.randint(1, 40))
        for _ in range(5):
            own = set(base)
            for _ in range(random.randint(0, 6)):
                own.discard(random.choice(base))
                own |= {random.randrange(2000)} if random.random() < 0.5 else set()
            sets.append(own or {1})
    rows = table(spark, [(1, i, s) for i, s in enumerate(sets)])
    met: dict[int, set[int]] = {}
    for r in _prefixes.shared_members(_prefixes.prefix_keys(rows, _prefixes.slot_counts(rows), tenths)).collect():
        met.setdefault(r.name, set()).add(r.node)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= tenths * len(sets[i] | sets[j])]
    assert len(near) > 20
    assert all(any({i, j} <= nodes for nodes in met.values()) for i, j in near)


def test_lines_of_one_template_meet_few_others(spark):
    random.seed(42)
    shared = set(range(100))
    rows = table(spark, [(1, i, shared | set(random.sample(range(1000, 10**9), 20))) for i in range(2000)])
    found = _prefixes.shared_members(_prefixes.prefix_keys(rows, _prefixes.slot_counts(rows), 8))
    assert found.where("n > 20").isEmpty()  # the template's own members, in all 2000 sets, name nothing


def test_groups_do_not_meet(spark):
    rows = table(spark, [(1, 1, {5, 6}), (2, 2, {5, 6}), (3, 3, {7}), (3, 4, {7})])
    got = _prefixes.shared_members(_prefixes.prefix_keys(rows, _prefixes.slot_counts(rows), 8)).collect()
    assert {(r.node, r.n) for r in got} == {(3, 2), (4, 2)}


@pytest.mark.parametrize("most", [2, 5, 64, 1000])
def test_dealt_nodes_are_connected(spark, most):
    rows = spark.createDataFrame([(name, 1000 * name + i, n) for name, n in ((1, 300), (2, 7)) for i in range(n)], "name long, node long, n long")
    sets: dict[int, list[int]] = {}
    for r in _prefixes.dealt(rows, most).collect():
        sets.setdefault(r.name, []).append(r.node)
    edges = spark.createDataFrame([(s[0], x) for s in sets.values() for x in s[1:]], "u long, v long")
    assert {(r.node, r.label) for r in _common.connected_components(edges).collect()} == {(1000 * name + i, 1000 * name) for name, n in ((1, 300), (2, 7)) for i in range(n)}
    assert max(map(len, sets.values())) <= max(4 * most, most + 30)


@pytest.mark.parametrize("most", [2, 6, 50])
def test_each_two_nodes_meet_across(spark, most):
    rows = spark.createDataFrame([(1, i, 30) for i in range(30)], "name long, node long, n long")
    sets: dict[int, set[int]] = {}
    for r in _prefixes.across(rows, most).collect():
        sets.setdefault(r.name, set()).add(r.node)
    assert all(any({i, j} <= s for s in sets.values()) for i in range(30) for j in range(i))


def test_empty_groups(spark):
    rows = spark.createDataFrame([], "name long, node long, hashes binary")
    found = _prefixes.shared_members(_prefixes.prefix_keys(rows, _prefixes.slot_counts(rows), 8))
    assert found.isEmpty() and _prefixes.dealt(found, 4).isEmpty() and _prefixes.across(found, 4).isEmpty()


def test_large_keys_of_several_components(spark):
    """Lines that share band keys by a common half; small groups of them are similar."""
    random.seed(43)
    common = " ".join(f"common{i}" for i in range(12))
    tail = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(24))
    tails = [tail() for _ in range(120)]
    rows = [(i, f"{common} {tails[i % 120]}{'x' * (i // 120)}") for i in range(240)]
    got = {m: sorted(map(tuple, line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string"), set_lines=m).collect())) for m in (4096, 8)}
    assert got[4096] == got[8]
    assert sum(r[2] for r in got[8]) >= 120


def test_lines_with_a_passage_in_common_are_not_compared_two_by_two(monkeypatch):
    """The work of a set grows with its lines; links are those of brute force."""
    random.seed(43)
    words = ["".join(random.choices("abcdefghiklmnoprstu", k=random.randint(3, 8))) for _ in range(3000)]
    passage = " ".join(random.choices(words, k=30))
    worked = []
    spread = line_dedup._spread
    monkeypatch.setattr(line_dedup, "_spread", lambda a, b: (worked.append(int((b - a).sum())), spread(a, b))[1])
    for n in (300, 1200):
        lines = [f"{' '.join(random.choices(words, k=20))} {passage} {' '.join(random.choices(words, k=20))}" for _ in range(n - 20)]
        lines += [f"{x} {random.choice(words)}" for x in lines[:20]]
        worked.clear()
        links = {tuple(sorted(x)) for x in line_dedup.similar_stars(lines)}
        assert links == {(i, n - 20 + i) for i in range(20)}
        assert sum(worked) < 10 * sum(map(len, lines))
