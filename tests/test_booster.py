"""The second-order booster: both ways of fitting, penalties, missing values, search."""
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gearlens.plans import booster as B
from gearlens.plans import model as ML

SCHEMA = "appointmentId long, a double, b double, c double, d double, y double, f0 double, features double"
FEATURES = ["a", "b", "c", "d"]


def rows(n=900, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = (None if r.random() < 0.2 else float(r.randrange(40))), r.choice([0.0, 1.0, float("nan")])
        c, d = r.gauss(0, 1), 7.0
        y = None if r.random() < 0.05 else 2 * math.sin(c) + (3.0 if a is None else a / 40) + (b == 1.0) + r.gauss(0, 0.1)
        out.append((i, a, b, c, d, y, 1.0, 2.0))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("s", [B.Settings(rounds=3, num_leaves=6, reg_lambda=0.5), B.Settings(rounds=12, num_leaves=3, min_rows=1, subsample=0.6, reg_alpha=0.2),
                               replace(B.DEPTHWISE, rounds=2, max_depth=4, colsample_bytree=0.6, colsample_bylevel=0.6),
                               B.Settings(rounds=2, num_leaves=None, max_depth=12, min_rows=1, subsample=0.9)])
def test_held_and_spread_fits_grow_the_same_trees(spark, table, s):
    """Broadcast table, distributed table, and another partitioning: one model."""
    lay, binned = B._prepared(table, FEATURES, "y", False, "appointmentId")
    mean, trees, _ = B._run(spark, lay, binned, [(s, None, [])], keep=True)[0]
    for spread in (binned, binned.repartition(3, "y")):
        got = B.Spread(spread, lay).fit(s)
        assert got[1] == trees and math.isclose(got[0], mean)
    model = B.to_model(spark, lay, mean, trees, "y")
    pred = {r.appointmentId: r.prediction for r in model.transform(table).select("appointmentId", "prediction").collect()}
    codes = lay.codes([np.array([math.nan if x[i] is None else x[i] for x in rows()]) for i in (1, 2, 3, 4)])
    want = mean + sum(B.predict(t, codes) for t in trees)
    assert all(math.isclose(pred[i], w, abs_tol=1e-9) for i, w in enumerate(want))


def plain_tree(codes, g, s, allowed=None):
    """One tree by trying every split of every leaf; best leaf first."""
    def value(idx):
        t = g[idx].sum()
        return -np.sign(t) * max(abs(t) - s.reg_alpha, 0) / (len(idx) + s.reg_lambda) * s.learning_rate

    def side(idx):
        t = np.sign(g[idx].sum()) * max(abs(g[idx].sum()) - s.reg_alpha, 0)
        return t * t / (len(idx) + s.reg_lambda)

    def best(idx):
        found = (0.0, None)
        for f in range(codes.shape[1]):
            for b in range(1, int(codes[:, f].max()) + 1):
                for low in (True, False):
                    left = np.where(codes[idx, f] == 0, low, codes[idx, f] <= b)
                    one, two = idx[left], idx[~left]
                    if min(len(one), len(two)) >= s.min_rows:
                        gain = round(side(one) + side(two) - side(idx), 9)
                        if gain > found[0] and gain > B.LEAST_GAIN:
                            found = (gain, (one, two))
        return found

    leaves = [(np.arange(len(g)), *best(np.arange(len(g))))]
    while len(leaves) < s.num_leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][1])
        if leaves[k][2] is None:
            break
        _, _, (one, two) = leaves.pop(k)
        leaves += [(one, *best(one)), (two, *best(two))]
    out = np.zeros(len(g))
    for idx, _, _ in leaves:
        out[idx] = value(idx)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_equal_plain_search(seed):
    """Growth, penalties and missing sides against every split tried by itself."""
    r = np.random.default_rng(seed)
    n = 150
    codes = np.stack([r.integers(0, 5, n), r.integers(1, 3, n), r.integers(0, 9, n)], 1).astype(np.uint8)
    y = codes[:, 0] * 0.3 + (codes[:, 2] == 0) * 2 + r.normal(0, 1, n)
    lay = B.Layout(["a", "b", "c"], [[1, 2, 3, 4], [1, 2], list(range(1, 9))])
    s = B.Settings(rounds=3, num_leaves=7, min_rows=4, reg_alpha=0.3 * seed, reg_lambda=0.5 * seed, learning_rate=0.5)
    held = B.Held(lay, np.arange(n), y, np.zeros(n, int), codes)
    mean, trees, _ = held.fit(s)
    pred = np.full(n, y.mean())
    for t in trees:
        pred += plain_tree(codes, pred - y, s)
    assert np.allclose(mean + sum(B.predict(t, codes) for t in trees), pred, atol=1e-7)


def test_missing_rows_go_where_they_fit(spark):
    """Missing values resemble the high side: one split sends them there, in the saved model too."""
    data = [(i, None if i % 3 == 0 else float(i % 10), 9.0 if i % 3 == 0 or i % 10 >= 7 else 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "appointmentId long, x double, y double")
    m = B.fit_boosted(df, ["x"], "y", B.Settings(rounds=1, num_leaves=2, learning_rate=1.0, min_rows=5))
    path = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/booster-model"
    ML.save_model(m, path)
    for model in (m, ML.load_model(path)):
        got = model.transform(df).collect()
        assert all(abs(r.prediction - r.y) < 1e-6 for r in got)
    other = spark.createDataFrame([(1, float("nan")), (2, 100.0), (3, -5.0)], "id int, x double")
    assert [round(r.prediction, 6) for r in m.transform(other).orderBy("id").collect()] == [9.0, 9.0, 1.0]


def test_awkward_tables(spark, table):
    s = B.Settings(rounds=2, num_leaves=4)
    none = B.fit_boosted(table.limit(0), FEATURES, "y", s)
    assert {r.prediction for r in none.transform(table).collect()} == {0.0}
    flat = B.fit_boosted(table.withColumn("y", F.lit(2.5)), FEATURES, "y", s)
    assert {r.prediction for r in flat.transform(table).collect()} == {2.5}
    blank = B.fit_boosted(table.withColumn("a", F.lit(None).cast("double")), ["a", "d"], "y", s)
    assert len({r.prediction for r in blank.transform(table).collect()}) == 1
    twice = B.fit_boosted(table.union(table), FEATURES, "y", replace(s, min_rows=40))
    once = B.fit_boosted(table, FEATURES, "y", s)
    a, b = (sorted(r.prediction for r in m.transform(table).collect()) for m in (twice, once))
    assert np.allclose(a, b, atol=1e-6)
    no_key = B.fit_boosted(table.drop("appointmentId"), FEATURES, "y", replace(s, subsample=0.5))
    assert no_key.transform(table).count() == table.count()


def test_many_valued_columns_are_cut_at_equal_ranks(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("few"))
    lay = B.layout_of(df, ["x", "few"], 11)
    assert lay.cuts[0].tolist() == [999.0 + 1000 * i for i in range(10)] and lay.cuts[1].tolist() == [0.0, 1.0, 2.0]


def test_search_shares_paths_and_equals_plain_cross_validation(spark, table):
    """Settings that differ in rounds only are one fit; every score is that of its own plain fit."""
    space = {"rounds": [2, 5], "num_leaves": [3, 6], "learning_rate": [0.3]}
    found = B.boosted_search(table, FEATURES, space, 4, 3, B.Settings(), "y")
    assert len({s for s, _ in found}) == 4
    spread = B.boosted_search(table, FEATURES, space, 4, 3, B.Settings(), "y", held_rows=0)
    assert [s for s, _ in spread] == [s for s, _ in found]
    for (s, score), (_, other) in zip(found, spread):
        assert math.isclose(score, other, abs_tol=1e-9)
    s, score = found[0]
    labelled = table.where("y IS NOT NULL")
    fold = ML.split_bucket("appointmentId") % 3
    lay, _ = B._prepared(table, FEATURES, "y", False, "appointmentId")
    plain = []
    for k in range(3):
        binned = B.binned(labelled.where(fold != k), lay, "y", "appointmentId").cache()
        mean, trees = B.Spread(binned, lay).fit(s)
        plain.append(ML.r2(B.to_model(spark, lay, mean, trees, "y"), labelled.where(fold == k), "y"))
    assert math.isclose(score, sum(plain) / 3, abs_tol=1e-6)


def test_importances_count_splits_and_gains(spark, table):
    m = B.fit_boosted(table, FEATURES, "y", B.Settings(rounds=4, num_leaves=5))
    splits = {r.feature: r.importance for r in ML.feature_importance(m, FEATURES, None, "split").collect()}
    gains = {r.feature: r.importance for r in ML.feature_importance(m, FEATURES, None, "gain").collect()}
    assert sum(splits.values()) == 16 and splits["d"] == gains["d"] == 0 and math.isclose(sum(gains.values()), 1.0) and splits["a"] > 0


def test_spaces_are_drawn_without_repeats():
    for name, (base, n, space) in B.SPACES.items():
        drawn = B.draw_settings(space, n, base)
        assert len(set(drawn)) == n == len(drawn) and drawn == B.draw_settings(space, n, base)
    assert len(B.draw_settings({"rounds": [1, 2]}, 10, B.Settings())) == 2


def test_histograms_sum_by_node_and_bin():
    r = np.random.default_rng(3)
    lay = B.Layout(["a", "b"], [[1.0, 2.0], [1.0, 2.0, 3.0]])
    codes = np.stack([r.integers(0, 3, 500), r.integers(0, 4, 500)], 1).astype(np.uint8)
    grad, node = r.integers(-9, 9, 500).astype(float), r.integers(0, 5, 500)
    g, n = B.histograms(codes, lay.at, grad, node, 5)
    for k in range(5):
        for f in range(2):
            for c in range(len(lay.cuts[f]) + 1):
                here = (node == k) & (codes[:, f] == c)
                assert g[k, lay.at[f] + c] == grad[here].sum() and n[k, lay.at[f] + c] == here.sum()


def test_a_distributed_round_takes_no_step_beyond_its_last_level(spark, table, monkeypatch):
    """A tree of two levels asks for the sums of its root and of the root's children only."""
    lay, binned = B._prepared(table, FEATURES, "y", False, "appointmentId")
    asked, splits = [], B.Spread._splits
    monkeypatch.setattr(B.Spread, "_splits", lambda *a: asked.append(len(a[4])) or splits(*a))
    B.Spread(binned, lay).fit(replace(B.DEPTHWISE, rounds=2, max_depth=2))
    assert asked == [1, 2, 1, 2]


def test_a_distributed_fit_leaves_no_plan_a_step_in_the_driver(spark, table, monkeypatch):
    """More rounds run no more queries: a step's plan held those of all tables before it, and filled the driver."""
    lay, binned = B._prepared(table, FEATURES, "y", False, "appointmentId")
    ran, frame = [], type(binned)
    for name in ("collect", "checkpoint", "persist"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), **b: ran.append(1) or f(self, *a, **b))
    queries = {}
    for rounds in (2, 6):
        ran.clear()
        assert len(B.Spread(binned, lay).fit(replace(B.DEPTHWISE, rounds=rounds, max_depth=2))[1]) == rounds
        queries[rounds] = len(ran)
    assert queries[2] == queries[6]


def test_rows_descend_to_the_wanted_nodes_only():
    """Walking a part of a tree finds the rows that routing step by step puts there."""
    r = np.random.default_rng(5)
    codes = r.integers(0, 9, (400, 3)).astype(np.uint8)
    lay = B.Layout(["a", "b", "c"], [list(range(1, 9))] * 3)
    held = B.Held(lay, np.arange(400), r.normal(0, 1, 400), np.zeros(400, int), codes)
    tree, at = held.grow(np.rint(r.normal(0, 99, 400)), np.ones(400, bool), B.Settings(num_leaves=None, min_rows=3), 0)
    leaves = np.flatnonzero(tree.left[:tree.size] < 0)
    for wanted in (leaves, leaves[::3]):
        ends = np.where(tree.left[:tree.size] < 0, -2, -1)
        ends[wanted] = wanted
        rows_, node = B.descend(codes, tree.down(), ends)
        got = dict(zip(rows_.tolist(), node.tolist()))
        assert got == {i: n for i, n in enumerate(at.tolist()) if n in set(wanted.tolist())}


def test_features_summed_together_have_their_own_sums():
    """Narrow features share one histogram of their combinations; every tree, node and bin gets the same sums."""
    r = np.random.default_rng(7)
    n, sizes = 3000, [3, 200, 4, 3, 2, 3]
    codes = np.stack([r.integers(0, k, n) for k in sizes], 1).astype(np.uint8)
    lay = B.Layout(list("abcdef"), [list(range(1, k)) for k in sizes])
    held = B.Held(lay, np.arange(n), np.zeros(n), np.zeros(n, int), codes)
    assert [len(of) for of, _, _ in held.together] == [5, 1] and held.together[0][2].shape[1] == 216
    rows_, grad = np.flatnonzero(r.random(n) < 0.7), r.integers(-99, 99, n).astype(float)
    for features in (range(6), [0, 1, 3], [1], [4]):
        part = lay.part(list(features))
        for nodes in (1, 4, 100):
            node = r.integers(0, nodes, len(rows_))
            got = held._histograms(part, rows_, grad[rows_], node, nodes)
            want = B.histograms(codes[rows_][:, list(features)], part.at, grad[rows_], node, nodes)
            assert all((a == b).all() for a, b in zip(got, want))


def test_rows_are_moved_block_by_block(monkeypatch):
    """A held fit does not depend on the rows taken at once, and only features that may split are searched."""
    r = np.random.default_rng(8)
    codes = r.integers(0, 9, (700, 4)).astype(np.uint8)
    lay = B.Layout(list("abcd"), [list(range(1, 9))] * 4)
    s = B.Settings(rounds=4, num_leaves=None, max_depth=9, min_rows=1, subsample=0.7, colsample_bytree=0.8, colsample_bylevel=0.5)
    y = codes[:, 0] - 2.0 * (codes[:, 1] == 0) + r.normal(0, 1, 700)
    fits = []
    for block in (B.BLOCK, 64):
        monkeypatch.setattr(B, "BLOCK", block)
        fits.append(B.Held(lay, np.arange(700), y, np.arange(700) % 3, codes).fit(s, np.arange(700) % 3 == 1, [2, 4]))
    assert fits[0] == fits[1]
    for number, tree in enumerate(fits[0][1]):
        assert {t[6] for t in tree if t[6] >= 0} <= set(B.tree_features(4, s, number))
