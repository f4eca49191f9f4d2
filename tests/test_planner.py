"""Budgets, path assignment and slots, on values worked out by hand."""

from windlass.plans import planner as L


def test_budget():
    assert L.split_budget(1000, 0.5, [], 20, 0.1) == L.Split(500, 2, 2)
    # training ends before the first physical attack, whose seconds count towards the test part's share
    s = L.split_budget(1000, 0.5, [(400, 430)], 20, 0.1)
    assert (s.train_end, s.train_injections, s.test_injections) == (400, 2, 1)
    assert L.split_budget(1000, 0.5, [(600, 900)], 20, 0.1).test_injections == 0


def test_paths_are_dealt_in_equal_shares():
    paths = [("a", "z"), ("b", "z"), ("c", "z")]
    out = L.assign_paths(paths, [4, 2])
    assert [len(x) for x in out] == [4, 2]
    assert all(sum(x.count(p) for x in out) == 2 for p in paths)
    assert L.assign_paths([], [3]) == [[]]


def test_slots_are_free_and_apart():
    labels = [0] * 40
    labels[10:15] = [1] * 5
    slots = L.first_free_slots(labels, 3, 4, 2, 40)
    taken = set(range(10, 15))
    for s, e in slots:
        assert e - s == 4 and s >= 2 and e <= 40 and not taken & set(range(s, e))
        taken |= set(range(s, e))
    assert len(slots) == 3 and L.first_free_slots([1] * 10, 1, 2, 0, 10) == []


def test_scaled_and_span():
    assert L.scaled([(1, 3)], 60, 10) == [(6, 18)]
    assert L.span(list(range(30)), 10, 100, 120, 20) == (list(range(8, 15)), 8, 14)
