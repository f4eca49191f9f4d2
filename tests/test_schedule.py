import random
from collections import Counter

from windlass.plans.planner import split_budget
from windlass.plans.schedule import budgets, free_slots, opened, spread, with_paths


def _labels(seed):
    rng = random.Random(seed)
    out = {}
    for exp in "abcd":
        n = rng.randrange(40, 90)
        hot = {w for s in [rng.randrange(n // 2, n - 3) for _ in range(3)] for w in range(s, s + 3)} if exp != "d" else set()
        out[exp] = [int(w in hot) for w in range(n)]
    return out


def test_plan_of_all_experiments(spark):
    labels = _labels(1)
    frame = spark.createDataFrame([(e, w, x) for e, ls in labels.items() for w, x in enumerate(ls)], "exp string, win long, label int")
    b = budgets(frame, 2, 0.6, 0.4)
    got = {r.exp: r for r in b.collect()}
    for e, ls in labels.items():
        runs = [(w, w + 1) for w, x in enumerate(ls) if x]
        want = split_budget(len(ls), 0.6, runs, 2, 0.4)
        assert (got[e].windows, got[e].train_end, got[e].train, got[e].test) == (len(ls), want.train_end, want.train_injections, want.test_injections)
    slots = free_slots(frame, b, 2)
    free = [tuple(r) for r in slots.collect()]
    for e, part, s in free:
        assert labels[e][s:s + 2] == [0, 0] and (s >= got[e].train_end if part else s + 2 <= got[e].train_end)
    chosen = [tuple(r) for r in spread(slots, b, 3).collect()]
    assert set(chosen) <= set(free) and len(chosen) == len(set(chosen))
    have = Counter((e, p) for e, p, _ in free)
    assert Counter((e, p) for e, p, _ in chosen) == Counter({k: m for k in have if (m := min(have[k], got[k[0]].test if k[1] else got[k[0]].train))})
    assert chosen != [tuple(r) for r in spread(slots, b, 4).collect()]
    paths = spark.createDataFrame([(k, ["x", f"y{k}", "z"]) for k in range(3)], "path_id long, path array<string>")
    planned = with_paths(spread(slots, b, 3), paths)
    n = Counter(r.path_id for r in planned.collect())
    assert set(n.values()) == {len(chosen) // 3}
    wins = opened(planned, 2, 60, (10, 60)).collect()
    assert len([r for r in wins if r.gran == 60]) == 2 * sum(n.values()) and len([r for r in wins if r.gran == 10]) == 12 * sum(n.values())
    assert all(r.start * 6 <= r.win < r.start * 6 + 12 for r in wins if r.gran == 10)


def test_no_path_no_slot_no_experiment(spark):
    frame = spark.createDataFrame([("a", w, 1) for w in range(5)], "exp string, win long, label int")
    b = budgets(frame, 2, 0.6, 0.4)
    assert free_slots(frame, b, 2).count() == 0
    none = spark.createDataFrame([], "path_id long, path array<string>")
    assert with_paths(spread(free_slots(frame, b, 2), b), none).count() == 0
    assert budgets(frame.limit(0), 2, 0.6, 0.4).count() == 0
