import random
from itertools import permutations

import pytest

from windlass.operators.paths import shortest_paths, simple_paths, trimmed_paths


def _plain(edges, start, goal, hops):
    """All simple paths by trying orders of nodes."""
    nodes = sorted({x for e in edges for x in e} - {goal})
    out = []
    for s in start:
        for n in range(hops):
            out += [[s, *mid, goal] for mid in permutations([x for x in nodes if x != s], n) if all(p in edges for p in zip([s, *mid], [*mid, goal]))]
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("limit", [1, 4, 25, 1000])
def test_first_paths_equal_all_paths_cut(spark, limit):
    rng = random.Random(limit)
    edges = {(a, b) for a in "abcdefg" for b in "abcdefgz" if a != b and rng.random() < 0.45} | {("a", "z")}
    frame = spark.createDataFrame([*edges, ("a", "a"), *list(edges)[:3]], "src string, dst string")
    want = _plain(edges, ["a", "c"], "z", 4)
    got = [r.path for r in shortest_paths(frame, ["a", "c", "z"], "z", 4, limit).collect()]
    assert got == want[:limit]
    assert sorted(r.path for r in simple_paths(frame, ["a", "c"], "z", 4).collect()) == sorted(want)


def test_growth_stops_at_the_limit(spark):
    edges = [(f"n{a:02}", f"n{b:02}") for a in range(20) for b in range(20) if a != b] + [(f"n{a:02}", "goal") for a in range(10)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    made = []
    got = shortest_paths(frame, ["n00"], "goal", 5, 12, made).collect()
    assert len(got) == 12 and sum(made) < 600  # of 5 hops there are more than 30,000 paths
    far = spark.createDataFrame([*edges, ("n00", "x"), ("x", "y"), ("y", "x2"), ("x2", "w")], "src string, dst string")
    made = []
    assert shortest_paths(far, ["n00"], "goal", 2, 1000, made).count() == 10 and made[1] < 20  # x leads nowhere


def test_trimming_makes_room_for_the_next_paths(spark):
    edges = {(a, b) for a in "abcde" for b in "abcdez" if a != b}
    frame = spark.createDataFrame(list(edges), "src string, dst string")
    every = _plain(edges, ["a"], "z", 4)
    for limit, share in ((20, 0.3), (20, 0.9), (10, 0.0)):
        first = every[:limit]
        gone = max(0, int((sum("b" in p for p in first) / len(first) - share) * len(first)))
        out = [p for p in reversed(first) if "b" in p][:gone]
        want = [p for p in every[:limit + gone] if p not in out]
        assert [r.path for r in trimmed_paths(frame, ["a"], "z", 4, limit, "b", share).collect()] == want
