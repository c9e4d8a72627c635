import numpy as np
import pytest
from pyspark.sql import functions as F

from titlegauge.operators import features, models, score
from titlegauge.operators import ridge as ridge_fit
from titlegauge.session import cut_lineage
from tests.test_labels import make_posts


def ridge(x, y, alpha):
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + alpha * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return w, y.mean() - x.mean(axis=0) @ w


def leave_one_out_error(x, y, alpha):
    """Mean squared leave-one-out error of a ridge fit, from its hat matrix."""
    n = len(y)
    centred = x - x.mean(axis=0)
    gram = centred @ centred.T
    hat = gram @ np.linalg.inv(gram + alpha * np.eye(n)) + np.ones((n, n)) / n
    return float(np.mean(((y - hat @ y) / (1 - np.diag(hat))) ** 2))


@pytest.fixture(scope="module")
def training(spark):
    posts = make_posts(spark, n=300, seed=8)
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 4000
    signal = F.when(F.col("title").contains("alpha"), 0.3).otherwise(0.1)
    return cut_lineage(posts.withColumn("label", signal + noise))


@pytest.fixture(scope="module")
def space(training):
    return cut_lineage(
        features.fit_space(training, intercept_factor=models.INTERCEPT_FACTOR)
    )


def dense(training, space, community):
    rows = features.long_features(
        features.featurize(
            training.filter(F.col("subreddit") == community), space, ["subreddit", "id", "label"]
        ),
        ["id", "label"],
    ).filter("kind <> 'i'").toPandas()
    x = rows.pivot_table(index="id", columns=["kind", "feature"], values="value", fill_value=0.0)
    y = rows.drop_duplicates("id").set_index("id").loc[x.index, "label"]
    return x, y.to_numpy()


@pytest.mark.parametrize("alpha", [0.1, 10.0])
def test_joint_fit_equals_each_closed_form(training, space, alpha):
    model = models.fit_ridge(training, space, alphas=(alpha,)).toPandas()
    for community in ("hot", "s0"):
        x, y = dense(training, space, community)
        w, b = ridge(x.to_numpy(), y, alpha)
        mine = model[model.subreddit == community].set_index(["kind", "feature"]).coef
        assert np.allclose(mine.loc[list(x.columns)].to_numpy(), w, atol=1e-5)
        intercept = mine.loc[("i", features.INTERCEPT)] * models.INTERCEPT_FACTOR
        assert intercept == pytest.approx(b, abs=1e-5)


def test_chosen_alpha_is_close_to_leave_one_out(training, space):
    chosen = models.fit_ridge(training, space).select("subreddit", "alpha").distinct().toPandas()
    chosen = dict(zip(chosen.subreddit, chosen.alpha))
    x, y = dense(training, space, "hot")
    errors = {a: leave_one_out_error(x.to_numpy(), y, a) for a in models.ALPHAS}
    assert errors[chosen["hot"]] <= 1.05 * min(errors.values())


def test_left_out_errors_over_chunks(monkeypatch, training):
    """The exact leave-one-out choice equals the hat matrix of each community, whatever the chunks."""
    monkeypatch.setattr(ridge_fit, "CHUNK_ROWS", 50)
    space = features.fit_space(training, analyzer=None, intercept_factor=models.INTERCEPT_FACTOR)
    indexed = cut_lineage(ridge_fit.with_local_index(space))
    rows, sizes = ridge_fit.row_chunks(training, indexed, 0, None, None)
    chosen = {r.subreddit: r for r in ridge_fit.choose_by_leaving_out(rows, sizes, models.ALPHAS).collect()}
    long = features.long_features(
        features.featurize(training, space, ["subreddit", "id", "label"], None), ["subreddit", "id", "label"]
    ).filter("kind <> 'i'").toPandas()
    for community in ("hot", "s0"):
        part = long[long.subreddit == community]
        x = part.pivot_table(index="id", columns="feature", values="value", fill_value=0.0)
        y = part.drop_duplicates("id").set_index("id").loc[x.index, "label"].to_numpy()
        errors = {a: len(y) * leave_one_out_error(x.to_numpy(), y, a) for a in models.ALPHAS}
        assert chosen[community].alpha == min(errors, key=errors.get)
        assert chosen[community].error == pytest.approx(min(errors.values()), rel=1e-8)
    monkeypatch.setattr(ridge_fit, "LOO_FEATURES", 3)
    with pytest.raises(ValueError):
        ridge_fit.choose_by_leaving_out(rows, sizes, models.ALPHAS)


def test_leave_one_out_identity():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 4)), rng.normal(size=12)
    brute = []
    for i in range(12):
        keep = np.arange(12) != i
        w, b = ridge(x[keep], y[keep], 2.0)
        brute.append((y[i] - x[i] @ w - b) ** 2)
    assert leave_one_out_error(x, y, 2.0) == pytest.approx(np.mean(brute))


def test_many_chunks_give_the_same_model(monkeypatch, training, space):
    """A community of many chunks takes its steps over the cluster, one pass each."""
    whole = models.fit_ridge(training, space, alphas=(10.0, 100.0), folds=2).toPandas()
    monkeypatch.setattr(ridge_fit, "CHUNK_ROWS", 100)
    assert training.groupBy("subreddit").count().filter("count > 100").count() >= 1
    parts = models.fit_ridge(training, space, alphas=(10.0, 100.0), folds=2).toPandas()
    key = ["subreddit", "kind", "feature", "alpha"]
    both = whole.merge(parts, on=key)
    assert len(both) == len(whole) and np.allclose(both.coef_x, both.coef_y, atol=1e-6)


def test_every_penalty_follows_from_the_steps_of_the_smallest():
    rng = np.random.default_rng(4)
    x, y, fold = rng.normal(size=(90, 12)), rng.normal(size=90), rng.integers(0, 3, 90)
    x[:, 3] *= 30
    row, idx = np.nonzero(np.ones_like(x))
    chunk = ridge_fit.Chunk(row, idx, x.ravel(), y, fold)
    alphas = (100.0, 0.1, 1.0)
    state = ridge_fit._solved_here(chunk, 12, 4, alphas)
    for k in range(4):
        mine = fold != k
        for a, alpha in enumerate(alphas):
            w, b = ridge(x[mine], y[mine], alpha)
            assert np.allclose(state.solution[k, a], w, atol=1e-6)
            assert state.label_mean[k] - state.mean[k] @ state.solution[k, a] == pytest.approx(b, abs=1e-6)


def test_folds_without_rows_and_constant_labels():
    x = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
    row, idx = np.nonzero(np.ones_like(x))
    for label in (np.zeros(3), np.ones(3)):
        chunk = ridge_fit.Chunk(row, idx, x.ravel(), label, np.zeros(3, int))
        state = ridge_fit._solved_here(chunk, 3, 3, (1.0, 2.0))
        assert np.allclose(state.solution, 0) and np.allclose(state.label_mean[-1], label[0])


def test_contributions_add_up_to_the_prediction(training, space):
    model = cut_lineage(models.fit_ridge(training, space, alphas=(1.0,)))
    predicted = score.predict(training, model, ["subreddit", "id"])
    explained = score.explain(predicted, k=10_000)
    sides = F.aggregate(
        F.concat("boosts", "hurts"), F.lit(0.0), lambda acc, c: acc + c["contribution"]
    )
    intercept = F.element_at(F.filter("features", lambda f: f["kind"] == "i"), 1)
    total = sides + intercept["value"] * intercept["coef"]
    worst = explained.select(F.max(F.abs(total - F.col("prediction")))).first()[0]
    assert worst < 1e-6


def test_preference_fit_has_zero_gradient(spark):
    titles = ["go now", "go home", "stay here", "stay now please", "now home", "here go please"]
    rows = [(i, titles[i % 6], titles[(i * 5 + 1) % 6], i % 2) for i in range(60)]
    rows = [r for r in rows if r[1] != r[2]]
    df = spark.createDataFrame(rows, "pair_index long, title_a string, title_b string, y int")
    model = models.fit_preference(df, ["pair_index"])
    size = model.count() - 1
    coef = {r.idx: r.coef for r in model.collect()}
    w = np.array([coef[i] for i in range(size)])
    rows = models.preference_rows(df, model.filter("kind <> 'i'").drop("coef"), ["pair_index"], None, "word").collect()
    x = np.zeros((len(rows), size))
    for at, r in enumerate(rows):
        x[at, r.idx] = r.value
    y = np.array([r.label for r in rows])
    p = 1 / (1 + np.exp(-(x @ w + coef[-1])))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    judged = {r.pair_index: r.correct for r in models.judge_preference(model, df, ["pair_index"]).collect()}
    assert judged == {r.pair_index: bool((x[at] @ w + coef[-1] > 0) == r.label) for at, r in enumerate(rows)}


def test_newton_steps_over_small_chunks_of_two_models(spark, monkeypatch):
    from titlegauge.operators import logit

    monkeypatch.setattr(logit, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for name, m in (("a", 4), ("b", 2)):
        x = rng.normal(size=(150, m)) * 3
        y = (x[:, 0] + rng.normal(size=150) > 0).astype(float)
        weight = rng.integers(1, 4, 150).astype(float)
        theta = np.zeros(m + 1)
        for _ in range(60):
            wide = np.column_stack([x, np.ones(150)])
            p = 1 / (1 + np.exp(-wide @ theta))
            ridge_part = np.append(np.ones(m), 0)
            hessian = (wide * (weight * p * (1 - p))[:, None]).T @ wide + np.diag(ridge_part)
            theta = theta - np.linalg.solve(hessian, wide.T @ (weight * (p - y)) + ridge_part * theta)
        want[name] = theta
        rows += [(name, float(b), float(c), list(range(m)), a.tolist()) for a, b, c in zip(x, y, weight)]
    df = spark.createDataFrame(rows, "subreddit string, label double, weight double, idx array<int>, value array<double>")
    sizes = spark.createDataFrame([("a", 4), ("b", 2)], "subreddit string, m int")
    got = {(r.subreddit, r.idx): r.coef for r in logit.fit(df, sizes).collect()}
    for name, theta in want.items():
        assert np.allclose([got[name, i] for i in [*range(len(theta) - 1), -1]], theta, atol=1e-7)


def test_a_community_of_many_rows_is_one_chunk_and_chunks_are_bounded_by_cells(monkeypatch, spark):
    """Steps over the cluster cost a pass each, so they are left to communities that no task can hold."""
    posts = spark.range(20_000).select(
        F.lit("s").alias("subreddit"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("word"), F.col("id") % 7, F.lit(" term"), F.col("id") % 11).alias("title"),
        (F.col("id") % 13 / 13).alias("label"),
    )
    space = cut_lineage(features.fit_space(posts, intercept_factor=models.INTERCEPT_FACTOR))
    chunks = lambda: ridge_fit.row_chunks(posts, cut_lineage(ridge_fit.with_local_index(space)), 0, "word", None)[1]
    assert chunks().first().chunks == 1
    whole = models.fit_ridge(posts, space, alphas=(1.0,), folds=0).toPandas()
    monkeypatch.setattr(ridge_fit, "CHUNK_CELLS", 80_000)
    assert chunks().first().chunks > 1
    parts = models.fit_ridge(posts, space, alphas=(1.0,), folds=0).toPandas()
    both = whole.merge(parts, on=["subreddit", "kind", "feature"])
    assert len(both) == len(whole) and np.allclose(both.coef_x, both.coef_y, atol=1e-6)


def test_products_in_blocks_are_those_of_the_matrix(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 9)) * (rng.random((40, 9)) < 0.4)
    row, idx = np.nonzero(x)
    chunk = ridge_fit.Chunk(row, idx, x[row, idx], rng.normal(size=40))
    monkeypatch.setattr(ridge_fit, "BLOCK_CELLS", 7)
    monkeypatch.setattr(ridge_fit, "BLOCK_ROWS", 6)
    v, w = rng.normal(size=9), rng.normal(size=40)
    assert np.allclose(chunk.times(v), x @ v) and np.allclose(chunk.back(w, 9), w @ x)
    assert np.allclose(np.concatenate([wide for wide, _ in chunk.dense(9)]), x)


def test_steps_over_few_features_do_not_read_the_rows_again(monkeypatch):
    """Products of few columns are summed once; of many, cells lie in order of row and of feature."""
    rng = np.random.default_rng(5)
    x, y, fold = rng.normal(size=(60, 6)), rng.normal(size=60), rng.integers(0, 2, 60)
    x[:, 1] += 50
    row, idx = np.nonzero(np.ones_like(x))
    # A feature that a row holds twice counts twice.
    twice = np.append(row, row[:6]), np.append(idx, idx[:6]), np.append(x.ravel(), x.ravel()[:6])
    order = np.argsort(twice[0], kind="stable")
    cells = [c[order] for c in twice]
    x[0] *= 2
    chunk = lambda: ridge_fit.Chunk(*cells, y, fold)
    monkeypatch.setattr(ridge_fit, "GRAM_FEATURES", 5)
    rows = chunk()
    by_rows = ridge_fit._solved_here(rows, 6, 3, (0.1, 10.0))
    assert rows.turned is not None
    monkeypatch.setattr(ridge_fit, "GRAM_FEATURES", 6)
    monkeypatch.setattr(ridge_fit.Chunk, "times", lambda *_: pytest.fail("the rows are read in a step"))
    by_grams = ridge_fit._solved_here(chunk(), 6, 3, (0.1, 10.0))
    assert np.allclose(by_rows.solution, by_grams.solution, atol=1e-7)
    for a, alpha in enumerate((0.1, 10.0)):
        assert np.allclose(by_grams.solution[-1, a], ridge(x, y, alpha)[0], atol=1e-7)


def test_turned_cells_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 11)) * (rng.random((30, 11)) < 0.3)
    x[4] = x[29] = 0.0
    x[:, 2] = x[:, 10] = 0.0
    row, idx = np.nonzero(x)
    chunk = ridge_fit.Chunk(row, idx, x[row, idx], np.zeros(30))
    monkeypatch.setattr(ridge_fit, "STRETCH_CELLS", 4)
    chunk.turn()
    v, w = rng.normal(size=11), rng.normal(size=30)
    assert np.allclose(chunk.times(v), x @ v) and np.allclose(chunk.back(w, 11), w @ x)


def test_equations_are_added_to_a_table_or_found_by_sorting(monkeypatch):
    from titlegauge.operators import logit

    rng = np.random.default_rng(11)
    x = rng.normal(size=(25, 6)) * (rng.random((25, 6)) < 0.5)
    y, weight, theta = (rng.random(25) < 0.5).astype(float), rng.integers(1, 4, 25).astype(float), rng.normal(size=7)
    row, idx = np.nonzero(x)
    value = x[row, idx]
    # The features of a row in any order, one of them twice.
    order = np.lexsort((rng.random(len(row)), row))
    row, idx, value = row[order], idx[order], value[order]
    x[row[0], idx[0]] += 1.5
    row, idx, value = np.r_[row[0], row], np.r_[idx[0], idx], np.r_[1.5, value]
    wide = np.column_stack([x, np.ones(25)])
    p = 1 / (1 + np.exp(-wide @ theta))
    want = (wide * (weight * p * (1 - p))[:, None]).T @ wide
    monkeypatch.setattr(logit, "PRODUCTS", 30)
    for cells in (logit.TABLE_CELLS, 1):
        monkeypatch.setattr(logit, "TABLE_CELLS", cells)
        if cells > 1:
            monkeypatch.setattr(np, "unique", lambda *_, **__: pytest.fail("sorted"))
        keys, (sums,) = logit._equations(ridge_fit.Chunk(row, idx, value, y, weight=weight), theta)
        monkeypatch.undo() if cells > 1 else None
        monkeypatch.setattr(logit, "PRODUCTS", 30)
        table = np.zeros((7, 7))
        np.add.at(table.reshape(-1), keys[keys >= 0], sums[keys >= 0])
        assert np.allclose(table, np.triu(want))
        gradient = np.zeros(7)
        gradient[-2 - keys[keys < -1]] = sums[keys < -1]
        assert np.allclose(gradient, wide.T @ (weight * (p - y)))
