import random

import pytest

from windlass.plans.driver import Config, run


def test_configurations_take_defaults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"avg_exfil_per_min": [1.0], "exfil_per_min_variance": [0.1], "unknown": 3, "model": null}')
    (tmp_path / "b.json").write_text("{}")
    found = {k.rsplit("/", 1)[1]: v for k, v in Config.read(spark, str(tmp_path)).items()}
    assert found["a.json"].avg_pkt_size == [500.0] and found["a.json"].time_interval_lengths == (10, 60) and found["a.json"].model == "lasso_path"
    assert len(found["b.json"].avg_exfil_per_min) == 5 and found["b.json"].goal_train_test_split_training == 1.0
    assert Config.of("{}", is_eval=True).goal_train_test_split_training == 0.0
    for wrong in ('{"avg_exfil_per_min": [1.0]}', '{"time_interval_lengths": [7, 60]}', '{"model": "none"}'):
        with pytest.raises(ValueError):
            Config.of(wrong)


def test_injected_windows_score_higher(spark):
    """Three experiments of noise between four services; what is injected shows in the scores of the test windows, and a saved model scores another run."""
    rng = random.Random(2)
    nodes = spark.createDataFrame([(f"{s}{k}", s) for s in "abcd" for k in range(2)] + [("internet", "internet")], "node string, svc string")
    rows = [(e, g, w, f"{s}{rng.randrange(2)}", f"{t}{rng.randrange(2)}", 3, int(rng.gauss(9000 * g, 400 * g))) for e in "xyz" for g in (10, 60) for w in range(60 * 60 // g) for s in "abc" for t in "bcd" if s != t]
    edges = spark.createDataFrame(rows, "exp string, gran int, win long, src string, dst string, frames long, weight long")
    labels = spark.createDataFrame([(e, w, 0) for e in "xyz" for w in range(60)], "exp string, win long, label int")
    paths = spark.createDataFrame([(0, ["a0", "b1", "internet"]), (1, ["a1", "c0", "d0", "internet"])], "path_id long, path array<string>")
    config = Config.of('{"goal_train_test_split_training": 0.5, "goal_attack_NoAttack_split_training": 0.4, "avg_exfil_per_min": [1.0], "exfil_per_min_variance": [0.05]}')
    scores, models = run(edges, labels, paths, nodes, config, seed=1)
    found = scores.collect()
    assert len(found) == 3 * (60 + 360) and set(models) == {(1.0, 10), (1.0, 60)}
    for g in (10, 60):
        test = [r for r in found if r.gran == g and r.is_test]
        one, zero = ([r.score for r in test if r.label == k] for k in (1.0, 0.0))
        assert one and min(one) > max(zero)
    assert {r.path_id for r in found if r.label} == {0, 1}
    again, _ = run(edges, labels, paths, nodes, Config.of('{"avg_exfil_per_min": [1.0], "exfil_per_min_variance": [0.05]}', is_eval=True), seed=7, models=models)
    rows = again.collect()
    assert all(r.is_test for r in rows) and len(rows) == len(found)
    assert min(r.score for r in rows if r.label) > sorted(r.score for r in rows if not r.label)[int(0.95 * sum(1 for r in rows if not r.label))]
