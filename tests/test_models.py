"""Recommenders and the search behind their lists, against brute force and planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsforge.models import bandit as BD
from oddsforge.models import contextual as CX
from oddsforge.models import inner_product as IP
from oddsforge.models import mf as MF
from oddsforge.models import network as NN


def vectors(spark, x, id_col):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{id_col} long, vec array<double>")


def test_inner_product_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    users, items = rng.normal(size=(60, 6)), rng.normal(size=(400, 6)) * rng.exponential(size=(400, 1)) ** 2
    users[3] = 0.0
    items[17] = items[11]          # a tie
    users[5] = items[11]
    got = IP.top_inner_products(vectors(spark, users, "user_id"), vectors(spark, items, "item_id"), 7, block=16)
    score = users @ items.T
    want = {u: sorted(range(400), key=lambda i: (-round(score[u, i], 12), i))[:7] for u in range(60)}
    lists = {}
    for r in got.table.orderBy("user_id", "rank").collect():
        lists.setdefault(r["user_id"], []).append(r["item_id"])
        assert abs(r["score"] - score[r["user_id"], r["item_id"]]) < 1e-9
    assert lists == want
    assert got.pairs == 24000 and got.compared < 0.6 * got.pairs and 0 < got.skipped_share < 1 and got.rounds > 1


def test_inner_product_search_of_little(spark):
    none = spark.createDataFrame([], "user_id long, vec array<double>")
    items = spark.createDataFrame([(1, [1.0]), (2, None), (None, [5.0])], "item_id long, vec array<double>")
    assert IP.top_inner_products(none, items, 3).table.count() == 0
    one = spark.createDataFrame([(9, [2.0])], "user_id long, vec array<double>")
    assert [tuple(r) for r in IP.top_inner_products(one, items, 3).table.collect()] == [(9, 1, 2.0, 1)]


@pytest.fixture(scope="module")
def planted(spark):
    """Ratings with a planted item bias and two factors, and what made them."""
    rng = np.random.default_rng(2)
    n_u, n_i = 120, 60
    bu, bi = rng.normal(0, 0.3, n_u), rng.normal(0, 1.0, n_i)
    p, q = rng.normal(size=(n_u, 2)) * 0.5, rng.normal(size=(n_i, 2)) * 0.5
    rows = [(u, i, float(3 + bu[u] + bi[i] + p[u] @ q[i] + rng.normal(0, 0.05))) for u in range(n_u) for i in range(n_i) if rng.random() < 0.5]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(u), int(i), float(r)) for u, i, r in rows], "user_idx int, item_idx int, rating double")
    return df.filter(F.pmod(F.xxhash64("user_idx", "item_idx"), F.lit(5)) > 0), df.filter(F.pmod(F.xxhash64("user_idx", "item_idx"), F.lit(5)) == 0), bi


def test_factorisation_recovers_a_planted_item_bias(spark, planted):
    train, val, bi = planted
    model = MF.fit(train, val=val, rank=4, reg=0.02, turns=3)
    assert model.losses[model.best_turn] == min(model.losses) and model.losses[model.best_turn] < 0.05
    got = {r["item_idx"]: r["b_i"] for r in model.items.collect()}
    assert np.corrcoef([got[i] for i in range(60)], bi)[0, 1] > 0.98
    assert abs(MF.validation_mse(model, val).first()["val_mse"] - min(model.losses)) < 1e-9
    users = {r["user_idx"]: r for r in model.users.collect()}
    items = {r["item_idx"]: r for r in model.items.collect()}
    for r in MF.predict(model, val.limit(50)).collect():
        u, i = users[r["user_idx"]], items[r["item_idx"]]
        assert abs(r["score"] - (model.mu + u["b_u"] + i["b_i"] + np.dot(np.array(u["p"], float), np.array(i["q"], float)))) < 1e-6
    unknown = spark.createDataFrame([(0, 999), (999, 0)], "user_idx int, item_idx int")
    assert [r["score"] for r in MF.predict(model, unknown).collect()] == [model.mu] * 2
    lists = {}
    for r in MF.recommend(model, 5).collect():
        lists.setdefault(r["user_idx"], {})[r["rank"]] = (r["item_idx"], r["score"])
    for u in (0, 7, 50):
        full = {i: model.mu + users[u]["b_u"] + x["b_i"] + float(np.dot(np.array(users[u]["p"], float), np.array(x["q"], float))) for i, x in items.items()}
        best = sorted(full, key=lambda i: -full[i])[:5]
        assert [lists[u][k + 1][0] for k in range(5)] == best and all(abs(lists[u][k + 1][1] - full[best[k]]) < 1e-6 for k in range(5))


def test_factorisation_gives_the_best_turn_back(spark, planted, monkeypatch):
    train, val, _ = planted
    losses = iter([0.5, 0.3, 0.4, 0.35, 0.1])
    seen = []

    class Fixed:
        def first(self):
            return {"val_mse": next(losses)}

    monkeypatch.setattr(MF, "validation_mse", lambda model, v: seen.append(model) or Fixed())
    model = MF.fit(train, val=val, rank=2, max_iter=1, turns=9, patience=2)
    assert model is seen[1] and model.losses == [0.5, 0.3, 0.4, 0.35] and len(seen) == 4
    from oddsforge.config import ModelConfig
    assert MF.fit.__defaults__[2] == ModelConfig.reg == 0.01


def test_network_beats_the_linear_scorer_on_a_planted_interaction(spark):
    from pyspark.ml.functions import array_to_vector

    from oddsforge.models import content as CT

    rng = np.random.default_rng(3)
    prof, item = rng.normal(size=(80, 3)), rng.normal(size=(50, 3))
    rows = [(u, i, float(2 + 2 * np.sign(prof[u, 0]) * item[i, 1] + abs(prof[u, 2]))) for u in range(80) for i in range(50) if rng.random() < 0.6]
    pairs = spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(40)
    profiles = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(prof)], "user_id long, profile array<double>")
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(item)], "item_id long, item array<double>")
    both = pairs.join(profiles, "user_id").join(items, "item_id").repartition(20)
    model = NN.fit(both, hidden=24, width=6, steps=70, rate=0.03)
    assert model.losses[-1] < 0.25 * model.losses[0]
    got = NN.score_pairs(model, pairs, profiles, items)
    mse = got.agg(F.avg((F.col("prediction") - F.col("rating")) ** 2)).first()[0]
    product = F.zip_with("profile", "item", lambda p, x: p * x)
    linear = CT.fit_scorer(both.withColumn("features", array_to_vector(F.concat("profile", "item", product))), reg=0.0)
    assert mse < 0.5 * linear.summary.meanSquaredError
    unknown = spark.createDataFrame([(0, 999), (999, 0)], "user_id long, item_id long")
    assert [r["prediction"] for r in NN.score_pairs(model, unknown, profiles, items).collect()] == [0.0, 0.0]
    top = NN.recommend_all(model, profiles, items, 4)
    every = spark.createDataFrame([(u, i) for u in range(0, 80, 20) for i in range(50)], "user_id long, item_id long")
    full = {(r["user_id"], r["item_id"]): r["prediction"] for r in NN.score_pairs(model, every, profiles, items).collect()}
    for u in range(0, 80, 20):
        mine = {r["rank"]: r for r in top.table.filter(F.col("user_id") == u).collect()}
        best = sorted(range(50), key=lambda i: -full[u, i])[:4]
        assert [mine[k + 1]["item_id"] for k in range(4)] == best and abs(mine[1]["score"] - full[u, best[0]]) < 1e-9


def test_gradient_is_the_derivative(spark):
    rng = np.random.default_rng(4)
    towers = NN.Towers({"u": 3, "i": 2}, 4, 2)
    flat = towers.start(1) + rng.normal(size=len(towers.start(1))) * 0.1
    x, y = {"u": rng.normal(size=(7, 3)), "i": rng.normal(size=(7, 2))}, rng.normal(size=7)
    g, _ = towers.gradient(flat, x, y)
    for j in rng.choice(len(flat), 12, replace=False):
        e = np.zeros(len(flat))
        e[j] = 1e-6
        assert abs((towers.gradient(flat + e, x, y)[1] - towers.gradient(flat - e, x, y)[1]) / 2e-6 - g[j]) < 1e-3


def test_boosting_patience(spark):
    assert CX.best_round([5, 4, 3, 3.5, 3.4, 2], 3) == (5, False)     # a late gain inside the patience
    assert CX.best_round([5, 4, 3, 3.5, 3.4, 3.3, 2], 3) == (2, True)
    assert CX.best_round([5, 4], 3) == (1, False)
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), "x" if c else "y", float((a > 0) ^ (b > 0) if rng.random() < 0.9 else c)) for a, b, c in zip(rng.normal(size=600), rng.normal(size=600), rng.random(600) < 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c string, label double").coalesce(1)
    train, val = df.limit(400), spark.createDataFrame(rows[400:], df.schema)
    model = CX.fit(train, ["a", "b"], ["c"], val=val, max_depth=2, max_iter=12, patience=3)
    from pyspark.ml.classification import GBTClassifier
    whole = GBTClassifier(labelCol="label", maxDepth=2, maxIter=12, seed=42).fit(model.stages[-2].transform(model.stages[0].transform(train)))
    losses = whole.evaluateEachIteration(model.stages[-2].transform(model.stages[0].transform(val)).select("features", "label"))
    assert model.stages[-1].getNumTrees == CX.best_round(list(losses), 3)[0] + 1
    assert CX.predict_proba(model, val.drop("label")).filter("p_positive is null").count() == 0


def test_choice_among_available_actions(spark):
    state = spark.createDataFrame([("a", 10, 6.0), ("b", 5, 3.0), ("c", 5, 3.0), ("new", 0, 0.0)], "action string, n long, reward_sum double")
    asks = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, ["a", "new", "never"]), (4, ["c", "b"]), (5, []), (6, None), (7, ["never", "new"]), (8, [None, "a"])],
                                 "decision_id long, actions array<string>")
    got = {r["decision_id"]: (r["action"], r["ucb_score"]) for r in BD.choose_available(state, asks, 1.0).collect()}
    b = 0.6 + np.sqrt(2 * np.log(20) / 5)
    assert {k: v[0] for k, v in got.items()} == {1: "b", 2: "a", 3: "new", 4: "c", 5: None, 6: None, 7: "never", 8: "a"}
    assert abs(got[1][1] - b) < 1e-12 and got[3][1] is None
    empty = state.limit(0)
    assert {r["action"] for r in BD.choose_available(empty, asks.filter("decision_id = 1")).collect()} == {"a"}
