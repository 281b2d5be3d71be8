"""Trees of bounded leaves, forests, boosting and ridge against plain definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricelattice.operators import forecast as fc
from pricelattice.operators import trees

FEATURES = ["a", "b", "c"]


def rows_of(n, seed=0, parts=1):
    draw = np.random.default_rng(seed)
    df = pd.DataFrame({"id": np.arange(n), "a": draw.integers(0, 40, n).astype(float), "b": draw.integers(0, 7, n).astype(float), "c": draw.integers(-300, 300, n) / 4,
                       "market": draw.choice(["north", "south", "east", "west"], n)})
    df["y"] = (np.where(df.a > 17, 64.0, -32.0) + 8 * df.b * (df.market == "south") + np.where(df.c > 31, 16, 0) + draw.integers(-3, 4, n)).round()
    df["part"] = np.arange(n) % parts
    return df


def table(spark, df, fits=1):
    return trees.packed(spark.createDataFrame(df), FEATURES, "market", "y", "part", ["id"], fits)


def plain_tree(df, depth, min_leaf, leaves=None):
    """Best-first growth by trying every threshold and every market on every leaf; returns the leaves as (row set, mean)."""
    def best(ix, level):
        y, found = df.y.to_numpy()[ix], (0.0, None)
        if level >= depth:
            return found
        ways = [((k, v), df[f].to_numpy()[ix] <= v) for k, f in enumerate(FEATURES) for v in sorted(set(df[f].to_numpy()[ix]))[:-1]]
        ways += [((3, m), df.market.to_numpy()[ix] == m) for m in sorted(set(df.market))]
        for name, left in ways:
            if min(left.sum(), (~left).sum()) >= min_leaf:
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if gain > found[0] + 1e-9:
                    found = (gain, left)
        return found

    open_ = [(np.arange(len(df)), 0, *best(np.arange(len(df)), 0))]
    while leaves is None or len(open_) < leaves:
        gain, k = max((leaf[2], -i) for i, leaf in enumerate(open_))
        if gain <= 1e-9:
            break
        ix, level, _, left = open_.pop(-k)
        open_ += [(part, level + 1, *best(part, level + 1)) for part in (ix[left], ix[~left])]
    return {tuple(ix): df.y.to_numpy()[ix].mean() for ix, *_ in open_}


@pytest.mark.parametrize("in_memory", [10 ** 6, 150, 0])
@pytest.mark.parametrize("depth,min_leaf,leaves", [(4, 5, None), (1 << 20, 20, 15), (1 << 20, 3, 2), (0, 1, None)])
def test_tree_equals_plain_growth(spark, monkeypatch, in_memory, depth, min_leaf, leaves):
    monkeypatch.setattr(trees, "IN_MEMORY", in_memory)
    monkeypatch.setattr(trees, "BLOCK", 64)
    df = rows_of(400)
    packed = table(spark, df)
    grown, = trees.grow(packed.blocks, [trees.Spec(0, trees.Rules(depth, min_leaf, leaves))], packed.rows, 3)
    at = grown.leaf(packed.cuts.bins([df[f].to_numpy() for f in FEATURES]), packed.cuts.numbers(df.market))
    got = {tuple(np.flatnonzero(at == k)): grown.mean[k] for k in set(at)}
    want = plain_tree(df, depth, min_leaf, leaves)
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert leaves is None or len(got) <= leaves


def test_more_values_than_bins(spark):
    df = rows_of(3000, 4)
    df["c"] = np.random.default_rng(1).normal(size=3000)
    cut = table(spark, df).cuts
    assert len(cut.edges[2]) <= 254 and cut.bins([df[f].to_numpy() for f in FEATURES]).max() <= 254
    assert (np.diff(np.bincount(cut.bins([df[f].to_numpy() for f in FEATURES])[:, 2])[:-1]) <= 2).all()  # even bins


def test_boosting_equals_rounds_by_hand(spark, monkeypatch):
    monkeypatch.setattr(trees, "RENEW", 2)
    monkeypatch.setattr(trees, "BLOCK", 64)
    df = rows_of(240, 2, parts=2)
    packed = table(spark, df, 2)
    models = trees.boosted(packed, trees.Rules(1 << 20, 10, 4), rounds=5, rate=0.25)
    bins, numbers = packed.cuts.bins([df[f].to_numpy() for f in FEATURES]), packed.cuts.numbers(df.market)
    for fit, model in enumerate(models):
        own = (df.part <= fit).to_numpy()
        now = np.full(own.sum(), df.y[own].mean())
        for tree in model.trees:
            left = df[own].assign(y=df.y[own].to_numpy() - now).reset_index(drop=True)
            at = tree.leaf(bins[own], numbers[own])
            want = plain_tree(left, 1 << 20, 10, 4)
            assert {tuple(np.flatnonzero(at == k)): pytest.approx(tree.mean[k]) for k in set(at)} == want
            now += 0.25 * tree(bins[own], numbers[own])
        assert np.allclose(model.predict(bins[own], numbers[own]), now) and len(model.trees) == 5


def test_forest_repeats_whatever_the_partitions(spark, monkeypatch):
    df = rows_of(500, 3)
    rules = trees.Rules(12, 3)
    first, = trees.forest(table(spark, df), rules, 12, 42)
    again, = trees.forest(trees.packed(spark.createDataFrame(df).repartition(7), FEATURES, "market", "y", "part", ["id"]), rules, 12, 42)
    monkeypatch.setattr(trees, "IN_MEMORY", 100)
    split, = trees.forest(table(spark, df), rules, 12, 42)
    bins, numbers = first.cuts.bins([df[f].to_numpy() for f in FEATURES]), first.cuts.numbers(df.market)
    want = first.predict(bins, numbers)
    assert np.allclose(again.predict(bins, numbers), want) and np.allclose(split.predict(bins, numbers), want)
    assert len({tuple(t.bin) for t in first.trees}) > 6  # rows are drawn anew for each tree
    weights = trees._weights(np.arange(100_000), 7)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03


def test_model_survives_saving(spark, folder):
    df = rows_of(300, 5)
    model, = trees.single(table(spark, df), trees.Rules(6, 5))
    model.save(spark, folder)
    loaded = trees.TreeModel.load(spark, folder)
    fresh = spark.createDataFrame(df.assign(market=df.market.where(df.id % 5 > 0, "unseen")))
    a, b = (m.transform(fresh).orderBy("id").toPandas().prediction for m in (model, loaded))
    assert np.array_equal(a, b)
    written = spark.read.parquet(f"{folder}/nodes").where("feature between 0 and 2").toPandas()
    assert (written.edge == [model.cuts.edges[f][k] for f, k in zip(written.feature, written.bin)]).all()


def prices(spark, days=150, markets="abcd"):
    draw = np.random.default_rng(9)
    out = []
    for m in markets:
        price = 1000.0 + 50 * ord(m)
        for k, day in enumerate(pd.date_range("2024-01-01", periods=days)):
            price = max(100.0, price + draw.normal(0, 20) + 15 * np.sin(k / 5))
            out.append((day.date(), "S", "D", m.upper(), m, "Onion", float(price), "s", "t", "REAL"))
    return spark.createDataFrame(out, "date date, state string, district string, market string, market_id string, commodity string, modal_price double, source string, source_tier string, data_mode string")


def test_ridge_equals_its_closed_form(spark):
    train = fc.build_features(prices(spark), "Onion")
    got = fc.fit_ridge(train, alpha=30.0).transform(train).select("date", "market_id", "prediction", "modal_price", *fc.NUMERIC_FEATURES).toPandas()
    x = got[fc.NUMERIC_FEATURES].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    x = np.hstack([x, pd.get_dummies(got.market_id).to_numpy(float)])
    centred, y = x - x.mean(axis=0), got.modal_price.to_numpy()
    beta = np.linalg.solve(centred.T @ centred + 30.0 * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    assert np.allclose(got.prediction, y.mean() + centred @ beta, rtol=1e-9)


def test_selection_fits_all_models_and_serves_the_chosen_one(spark, folder):
    x = prices(spark)
    result = fc.train_and_compare(x, "Onion", sizes=fc.ModelSizes(8, 12))
    rows = {r.model: r for r in result.comparison.collect()}
    assert set(rows) == {fc.PERSISTENCE, fc.LAG7, *fc.MODELS} and len({r.n for r in rows.values()}) == 1
    chosen = min(rows.values(), key=lambda r: (r.validation_mae, r.validation_rmse, r.model))
    assert [r.model for r in rows.values() if r.selected_on_validation] == [chosen.model] == [result.selected]
    frame = fc.temporal_split(fc.build_features(x, "Onion"))
    train, test = frame.where(F.col("split") == "train"), frame.where(F.col("split") == "test")
    both = frame.where(F.col("split") != "test")
    # the second fit's bins come from the training rows; its ridge is the one on both parts
    direct = fc.evaluate(test, {fc.RIDGE: fc.fit_ridge(both)})[0].where(F.col("model") == fc.RIDGE).first()
    assert direct.mae == pytest.approx(rows[fc.RIDGE].mae)
    alone = fc.fit(train, [fc.TREE])[fc.TREE]
    first = fc.evaluate(frame.where(F.col("split") == "validation"), {fc.TREE: alone})[0].where(F.col("model") == fc.TREE).first()
    assert first.mae == pytest.approx(rows[fc.TREE].validation_mae)
    for name, model in ((fc.BOOSTING, fc.fit(train, [fc.BOOSTING], fc.ModelSizes(2, 3))[fc.BOOSTING]), (fc.RIDGE, fc.fit_ridge(train)), (fc.PERSISTENCE, None)):
        saved = fc.TrainingResult(name, result.comparison, result.validation, result.predictions, result.latest, model)
        fc.save_artifacts(saved, x, f"{folder}/{name[:2]}")
        loaded = fc.load_model(spark, f"{folder}/{name[:2]}")
        if model is None:
            assert loaded is None
        else:
            a, b = (fc.forecast_latest(x, name, m, "Onion").orderBy("market_id").toPandas().predicted_next_report_price for m in (model, loaded))
            assert np.allclose(a, b) and len(a) == 4
