"""Ranks, folds, models, comparison, sources and sinks."""
import hashlib
import math
import pathlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames_help import rows
from metrospan.operators import design as D
from metrospan.operators import diff as V
from metrospan.operators import folds as K
from metrospan.operators import models as M
from metrospan.operators import provenance as Q
from metrospan.operators import ranks as R
from metrospan.operators.contracts import ContractViolation
from metrospan.sources import sinks, tables


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-test-", dir="/tmp")


def test_ranks_with_a_hot_partition(spark):
    random.seed(0)
    data = [("hot" if i % 3 else f"k{i % 7}", random.randint(0, 50), i) for i in range(3000)]
    d = spark.createDataFrame(data, "k string, v int, id int").repartition(7)
    got = {(r.k, r.id): r["rank"] for r in R.ordered_rank(d, [F.col("v").desc(), F.col("id")], ["k"]).collect()}
    for k in {x[0] for x in data}:
        order = sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[k, x[2]] for x in order] == list(range(1, len(order) + 1))
    u = d.withColumn("u", (F.abs(F.hash("id")) % 997 + 0.5) / 997)
    ranks = sorted((r.u, r.id, r["rank"]) for r in R.uniform_rank(u, "u", ["id"]).collect())
    assert [r for _, _, r in ranks] == list(range(1, 3001))


def test_id_chunks_keep_every_id(spark):
    d = spark.createDataFrame([("a", f"{i % 250:04d}") for i in range(500)] + [("b", "x")], "g string, i string")
    c = R.id_list_chunks(d, ["g"], "i", chunk=40)
    ids = [i for r in sorted(c.where("g = 'a'").collect(), key=lambda r: r.chunk_no) for i in r.ids.split("|")]
    assert ids == [f"{i:04d}" for i in range(250)] and max(r.n_ids for r in c.collect()) == 40


@pytest.mark.parametrize("seed,k", [(0, 3), (1, 4), (2, 2), (3, 5)])
def test_group_kfold_is_the_greedy_assignment(spark, seed, k):
    rng = random.Random(seed)
    groups = [(f"g{i:03d}", rng.choice([1, 1, 1, 2, 3, 5, 8, 40])) for i in range(120)]
    loads, want = [0] * k, {}
    for name, n in sorted(groups, key=lambda x: (x[1], x[0]), reverse=True):
        f = loads.index(min(loads))
        want[name], loads[f] = f, loads[f] + n
    got = K.group_kfold(spark.createDataFrame(groups, "g string, n long"), "g", k)
    assert {r.g: r.fold for r in got.collect()} == want


def test_splits_are_exact_and_stable(spark):
    d = spark.range(180)
    s = K.three_way_split(d, "id", 1)
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 108, "validation": 36, "test": 36}
    assert rows(s, "id", "split") == rows(K.three_way_split(d.repartition(5), "id", 1), "id", "split")
    h = K.stratified_sample(d, "id", {"a": (0.0, 1.0), "b": (5.0, 6.0)}, 2).collect()
    assert sorted(int(r.a * 180) for r in h) == list(range(180)) and sorted(int((r.b - 5) * 180) for r in h) == list(range(180))


def study(spark, n=6, per=8):
    rng = np.random.default_rng(0)
    data = []
    for g in range(n):
        for _ in range(per + g):
            x = rng.normal(g, 1), rng.normal(0, 2)
            data.append((f"c{g}", float(x[0]), float(x[1]), float(3 * x[0] - x[1] + 10 + rng.normal(0, 0.5))))
    return spark.createDataFrame(data, "g string, a double, b double, y double"), data


def brute_ridge(train, alpha):
    groups = [r[0] for r in train]
    w = np.array([1 / groups.count(k) for k in groups])
    w = w * len(w) / w.sum()
    X, y = np.array([r[1:3] for r in train]), np.array([r[3] for r in train])
    mx, my = np.average(X, axis=0, weights=w), np.average(y, weights=w)
    sx = np.sqrt(np.average((X - mx) ** 2, axis=0, weights=w))
    sy = math.sqrt(np.average((y - my) ** 2, weights=w))
    Z, t = (X - mx) / sx, (y - my) / sy
    beta = np.linalg.solve(Z.T @ (w[:, None] * Z) + alpha * np.eye(2), Z.T @ (w * t))
    return lambda q: my + sy * ((np.array(q) - mx) / sx) @ beta


def test_nested_ridge_against_numpy(spark):
    d, data = study(spark)
    scores, chosen = M.nested_ridge(d, "g", ["a", "b"], "y", [0.1, 50.0])
    folds = {(r.outer, r.g): r.fold for r in M.nested_folds(d.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g", 3).collect()}
    table = {(r.outer, r.candidate): r.inner_rmse for r in scores.collect()}
    for outer in ("c0", "c3"):
        train = [r for r in data if r[0] != outer]
        for i, alpha in enumerate((0.1, 50.0)):
            mse = []
            for g in sorted({r[0] for r in train}):
                f = brute_ridge([r for r in train if folds[outer, r[0]] != folds[outer, g]], alpha)
                mse.append(np.mean([(f(r[1:3]) - r[3]) ** 2 for r in train if r[0] == g]))
            assert table[outer, i] == pytest.approx(math.sqrt(np.mean(mse)), rel=1e-8)
    oof = M.linear_predictions(d, chosen.select("outer", "alpha", "coef"), "g", ["a", "b"], "y", d)
    alpha = {r.outer: r.alpha for r in chosen.collect()}
    for r in oof.collect():
        f = brute_ridge([x for x in data if x[0] != r.g], alpha[r.g])
        assert r.pred == pytest.approx(f((r.a, r.b)), rel=1e-8)
    assert oof.count() == len(data)


def test_scaling_never_sees_the_held_out_condition(spark):
    d, data = study(spark)
    s = {(r.held_out, r.feature): r["mean"] for r in M.fold_scaling(d, "g", ["a"]).collect()}
    rest = [np.mean([x[1] for x in data if x[0] == g]) for g in ("c1", "c2", "c3", "c4", "c5")]
    assert s["c0", "a"] == pytest.approx(np.mean(rest))


def test_fourier_family_learns_a_curve(spark):
    rng = np.random.default_rng(1)
    data = [(f"c{i % 5}", float(x), float(np.sin(2 * x))) for i, x in enumerate(rng.uniform(-1, 1, 200))]
    d = spark.createDataFrame(data, "g string, x double, y double")
    for eps in (None, 0.05):
        _, oof = M.fourier_nested(d, "g", ["x"], "y", gammas=(0.5,), alphas=(0.01,), inner=2, size=32, epsilon=eps, rounds=3)
        e = [(r.pred - r.y) ** 2 for r in oof.collect()]
        assert len(e) == 200 and np.mean(e) < 0.02


def test_importance_ranks_the_used_feature(spark):
    d = spark.createDataFrame([(i, float(i % 17), float(i % 5), float(i % 17)) for i in range(200)], "id int, a double, b double, y double")
    imp = {r.feature: r.mae_increase_mean for r in M.permutation_importance(d, "id", ["a", "b"], "y", lambda t: t.withColumn("pred", F.col("a")), 3, 0).collect()}
    assert imp["a"] > 1 and imp["b"] == 0


def test_farthest_points_against_brute_force(spark):
    pts = np.random.default_rng(8).random((60, 2))
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, a double, b double")
    w = D.importance_weights([3.0, -1.0])
    p = pts * np.sqrt(w)
    pick = [int(np.argmin(((pts - 0.5) ** 2).sum(1)))]
    while len(pick) < 10:
        dist = np.min([((p - p[i]) ** 2).sum(1) for i in pick], axis=0)
        dist[pick] = -1
        pick.append(int(np.argmax(dist)))
    got = [r.id for r in D.farthest_points(d, "id", ["a", "b"], w, 10).orderBy("selection_index").collect()]
    assert w == [0.1 + 0.7, 0.1] and got == pick


def test_diff_policy(spark):
    a = spark.createDataFrame([(1, "x", 1.0, 5), (2, "y", 0.0, 6), (3, None, 2.0, 7)], "k int, s string, v double, n int")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-9, 5), (2, "Y", 1e-3, 6), (3, None, None, 8)], "k int, s string, v double, n int")
    r = {x.column: x for x in V.table_diff(a, b, ["k"], ["s"], ["v"], ["n"]).collect()}
    assert r["s"].different_rows == 1 and r["n"].different_rows == 1 and r["n"].mode == "exact_discrete"
    assert r["v"].different_rows == 2 and not r["v"].missing_mask_equal and r["v"].unbounded_relative_error_count == 1
    spec = dict(key=["k"], exact=["s"], numeric=["v"], discrete=["n"])
    assert V.artifact_status(a, b, **spec).first().status == "VALUE_CHANGED"
    assert V.artifact_status(a, a, **spec).first().status == "IDENTICAL"
    assert V.artifact_status(a, a.limit(1), **spec).first().status == "ROW_COUNT_CHANGED"
    assert V.artifact_status(a, a.select("k", "v", "s", "n"), **spec).first().status == "COLUMN_ORDER_CHANGED"
    assert V.artifact_status(None, a, **spec).first().status == "MISSING_ARTIFACT"


@pytest.mark.parametrize("a,b,equal", [('{"a":1,"b":[1,2]}', '{"b":[1,2], "a":1.0}', True), ('{"a":[1,2]}', '{"a":[2,1]}', False),
                                       ('{"a":1}', '{"a":1,"b":2}', False), ('{"a":true}', '{"a":1}', False), ('{"a":1,"a":1}', '{"a":1}', None),
                                       ('{"a":1.000000001}', '{"a":1}', True), ('["1"]', "[1]", False)])
def test_json_cells(spark, a, b, equal):
    d = spark.createDataFrame([(a, b)], "a string, b string")
    assert d.select(V.json_cells_equal(F.col("a"), F.col("b"))).first()[0] is equal


@pytest.mark.parametrize("text,status", [('{"a":1}', "ok"), ('{"a":1,"a":2}', "repeated_key"), ('{"o":{"a":1,"\\u0061":2}}', "repeated_key"),
                                         ('[{"a":1},{"a":2}]', "ok"), ("{bad", "malformed"), (None, "missing")])
def test_json_status(spark, text, status):
    assert spark.createDataFrame([(text,)], "t string").select(tables.json_status(F.col("t"))).first()[0] == status


def write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_strict_csv(spark, folder):
    ok = tables.read_strict_csv(spark, write(folder, "ok.csv", "﻿run_id , T_C\n007,25.5\n"))
    assert ok.dtypes == [("run_id", "string"), ("T_C", "double")] and rows(ok, "run_id", "T_C") == [("007", 25.5)]
    quoted = tables.read_strict_csv(spark, write(folder, "quoted.csv", '"a, b",note\n1,"two\nlines"\n'), multiline=True)
    assert quoted.columns == ["a, b", "note"] and rows(quoted, "note") == [("two\nlines",)]
    several = folder / "several" if hasattr(folder, "joinpath") else f"{folder}/several"
    import os
    os.makedirs(several, exist_ok=True)
    for k, head in enumerate(("a,b", "a,c")):
        with open(f"{several}/{k}.csv", "w") as f:
            f.write(f"{head}\n1,2\n")
    with pytest.raises(ContractViolation, match="headers differ"):
        tables.read_strict_csv(spark, str(several))
    for name, text in {"dup": "a, a\n1,2\n", "blank": "a,,b\n1,2,3\n", "open": 'a,"b\n1,2\n', "none": ""}.items():
        with pytest.raises(ContractViolation):
            tables.read_strict_csv(spark, write(folder, f"{name}.csv", text))
    bad = tables.read_strict_csv(spark, write(folder, "bad.csv", "run_id,T_C\n1,warm\n"))
    with pytest.raises(Exception):
        bad.collect()


def test_sinks_never_overwrite(spark, folder):
    d = spark.range(3)
    path = sinks.write_once(d, f"{folder}/out")
    with pytest.raises(FileExistsError):
        sinks.write_once(d, path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_once(d, tempfile.mkdtemp(prefix="spark-test-", dir="/tmp"))  # empty folder is fine
    with pytest.raises(ContractViolation):
        sinks.write_report(spark.range(1).select(F.lit(float("inf")).alias("v")), f"{folder}/report")
    meta = spark.range(1).select(F.lit("outer_evaluation").alias("role"))
    sinks.save_models(d, meta, f"{folder}/model")
    with pytest.raises(ContractViolation, match="role"):
        sinks.load_models(spark, f"{folder}/model", "final_all_labels")


def test_changed_bytes_are_found(spark, folder):
    for n in ("a", "b"):
        write(folder, f"{n}.txt", n)
    before = spark.createDataFrame(Q.file_fingerprints(spark, folder).collect())
    Q.verify(before, Q.file_fingerprints(spark, folder))
    write(folder, "b.txt", "B")
    assert [r.status for r in Q.changed_files(before, Q.file_fingerprints(spark, folder)).collect()] == ["changed"]
    with pytest.raises(ContractViolation, match="b.txt"):
        Q.verify(before, Q.file_fingerprints(spark, folder))


def test_long_files_are_hashed_block_by_block(spark, folder):
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 700_001, dtype=np.uint8).tobytes()
    files = {"noise.bin": noise, "ended.bin": noise[:300_000] + b"\n", "marked.csv": b"\xef\xbb\xbfa,b\r\n" + b"1,2\r\n" * 60_000,
             "marked_open.csv": b"\xef\xbb\xbf" + b"1\n" * 90_000 + b"x", "lines.txt": b"\n" * 250_000, "one.txt": b"x" * 400_000,
             "packed.gz": noise[:200_000], "short.txt": b"a", "\u00e4 b%20.txt": noise[::-1]}
    for name, data in files.items():
        (pathlib.Path(folder) / name).write_bytes(data)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = Q.file_fingerprints(spark, folder, whole=100_000, block=150_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in found} == {
        name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    assert len(found) == len(files)


def forest_rows(spark, n, conditions):
    d = spark.range(n, numPartitions=4).select(F.concat(F.lit("c"), F.col("id") % conditions).alias("g"), *[
        (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000).alias(f"x{k}") for k in range(3)], (F.pmod(F.xxhash64("id"), F.lit(10))).alias("x3"))
    return d.withColumn("y", F.col("x0") * 3 + F.sin(F.col("x1") * 6) + 100)


def test_nested_forest_is_as_good_as_separate_fits(spark):
    d = forest_rows(spark, 12_000, 3).cache()
    f = ["x0", "x1", "x2"]
    oof = M.forest_nested(d, "g", f, "y", trees=40, depth=5)
    assert oof.columns == [*d.columns, "pred", "min_leaf"] and oof.count() == 12_000
    error = {r.g: r.e for r in oof.groupBy("g").agg(F.avg((F.col("pred") - F.col("y")) ** 2).alias("e")).collect()}
    model = M.fit_forest(d.where("g <> 'c0'"), f, "y", 0, 40, 1, None, 5)
    alone = M.forest_predict(model, d.where("g = 'c0'"), f).agg(F.avg((F.col("pred") - F.col("y")) ** 2)).first()[0]
    spread = d.agg(F.var_pop("y")).first()[0]
    assert max(error.values()) < 1.25 * alone < 0.5 * spread


def test_nested_forest_runs_as_many_jobs_for_more_conditions(spark):
    jobs = []
    for conditions in (3, 8):
        name = f"forest-{conditions}"
        spark.sparkContext.setJobGroup(name, name)
        d = forest_rows(spark, 800, conditions)
        assert M.forest_nested(d, "g", ["x0", "x1"], "y", trees=2, depth=2).count() == 800
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 10


def test_nested_forest_splits_where_the_target_steps(spark):
    d = forest_rows(spark, 3000, 3).withColumn("y", F.when(F.col("x3") >= 6, 7.0).otherwise(2.0))
    for depth in (1, 11):  # nodes in an array, nodes in a map
        oof = M.forest_nested(d, "g", ["x3"], "y", leaves=(10**9, 3), trees=3, depth=depth)
        worst = oof.agg(F.max(F.abs(F.col("pred") - F.col("y"))), F.min("min_leaf"), F.max("min_leaf")).first()
        assert worst[0] < 1e-9 and worst[1:] == (3, 3)
    whole = M.forest_nested(d, "g", ["x3"], "y", leaves=(10**9,), trees=30, depth=2)
    r = whole.agg(F.avg("pred"), F.avg("y"), F.count_distinct("g", "pred")).first()
    assert abs(r[0] - r[1]) < 0.1 and r[2] == 3  # nothing splits: one mean a condition


def test_nested_forest_bootstrap_counts(spark):
    d = forest_rows(spark, 6000, 3)
    edges = [[0.25, 0.5], [0.5]]
    cells = M._forest_cells(d, "g", ["x0", "x1"], "y", edges, 100.0, 8, 1)
    n = {r.tree: r.n for r in cells.groupBy("tree").agg(F.sum("n").alias("n")).collect()}
    assert n.pop(-1) == 6000 and set(n) == set(range(8)) and len(set(n.values())) > 1
    assert all(abs(v - 6000) < 5 * 6000 ** 0.5 for v in n.values())
    whole = cells.where("tree = -1").agg(F.sum(F.col("n") * F.col("mean")) / 6000, F.sum(F.col("n") * (F.col("var") + F.col("mean") ** 2)) / 6000).first()
    y = d.agg(F.avg(F.col("y") - 100), F.avg((F.col("y") - 100) ** 2)).first()
    assert whole[0] == pytest.approx(y[0]) and whole[1] == pytest.approx(y[1])
    with pytest.raises(Exception, match="targets must be numbers"):
        M._forest_cells(d.withColumn("y", F.lit(None).cast("double")), "g", ["x0"], "y", [[0.5]], 0.0, 1, 1).collect()


def test_nested_forest_grows_to_the_end(spark):
    d = forest_rows(spark, 3000, 3).withColumn("y", F.pmod(F.col("x3") * 7, F.lit(10)) * 1.0 + F.floor(F.col("x0") * 4) * 100)
    d = d.withColumn("x0", F.floor(F.col("x0") * 4))
    oof = M.forest_nested(d, "g", ["x0", "x3"], "y", trees=5)  # 40 leaves of 75 rows: deeper than five levels
    assert oof.agg(F.max(F.abs(F.col("pred") - F.col("y")))).first()[0] < 1e-9


def test_forest_query_grows_whole_forests(spark, tmp_path):
    from metrospan.plans import QUERIES
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    spark.range(6000).select(
        F.col("id").alias("o_orderkey"), h(1, 1500).alias("o_custkey"), F.element_at(F.array(*map(F.lit, "FOP")), (h(2, 3) + 1).cast("int")).alias("o_orderstatus"),
        (h(3, 400000) + 900.0).alias("o_totalprice"), F.date_add(F.lit("1995-01-01"), h(4, 365).cast("int")).cast("timestamp").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    r = QUERIES["forest_cv"](spark, str(tmp_path)).collect()
    assert len(r) == 3 and sum(x.n_measurements for x in r) == 6000
    assert min(x.r2 for x in r) > 0.98  # six trees of depth three: 0.71 at most on the given orders


def test_nested_forest_splits_large_nodes_by_aggregates(spark, monkeypatch):
    d = forest_rows(spark, 2000, 4)

    def predictions(cells, fits, depth):
        monkeypatch.setattr(M, "_NODE_CELLS", cells)
        monkeypatch.setattr(M, "_TASK_FITS", fits)
        return [r.pred for r in M.forest_nested(d, "g", ["x0", "x3"], "y", trees=3, depth=depth, bins=8).orderBy("g", "x0", "x1", "x2").collect()]

    for depth in (None, 3):
        want = predictions(1 << 20, 100, depth)
        assert np.allclose(want, predictions(60, 100, depth), rtol=0, atol=1e-9)
        assert np.allclose(want, predictions(1 << 20, 5, depth), rtol=0, atol=1e-9)


@pytest.mark.parametrize("leaf, levels", [(1, None), (3, None), (2, 3), (1, 0)])
def test_tree_values_are_those_of_a_tree_grown_node_by_node(leaf, levels):
    rng = np.random.default_rng(5)
    x, seen = rng.integers(0, 12, (150, 3)), rng.integers(0, 12, (80, 3))
    n = rng.integers(1, 4, 150)
    w, m = n / 7.0, rng.normal(size=150)

    def grow(rows, asked, left):
        value = np.average(m[rows], weights=w[rows])
        best = None
        for k in range(3 if left != 0 else 0):
            for e in np.unique(x[rows, k])[:-1]:
                low, high = rows[x[rows, k] <= e], rows[x[rows, k] > e]
                if min(n[low].sum(), n[high].sum()) >= leaf:
                    gain = np.float32(sum(w[p].sum() * (np.average(m[p], weights=w[p]) - value) ** 2 for p in (low, high)))
                    if best is None or gain > best[0]:
                        best = gain, k, e, low, high
        if best is None:
            return {i: value for i in asked}
        _, k, e, low, high = best
        return {**grow(low, [i for i in asked if seen[i, k] <= e], left and left - 1), **grow(high, [i for i in asked if seen[i, k] > e], left and left - 1)}

    want = grow(np.arange(150), range(80), levels)
    assert np.allclose(M._tree_values(x, n, w, w * m, seen, leaf, levels), [want[i] for i in range(80)])


def test_permutation_importance_broadcasts_no_table(spark):
    n = 60000
    d = spark.range(n).select(F.col("id"), (F.col("id") % 1000).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    d = d.withColumn("y", F.col("a") * 1.0)
    df = M.permutation_importance(d, "id", ["a", "b"], "y", lambda t: t.withColumn("pred", F.col("a")), 1, 0)
    imp = {r.feature: r.mae_increase_mean for r in df.collect()}
    assert imp["b"] == 0 and imp["a"] == pytest.approx(1000 / 3, rel=0.02)
    sent, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if name == "BroadcastExchange":
            sent.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    assert all(k < n / 10 for k in sent)


def test_weights_of_a_fit_by_condition():
    import pandas as pd
    fit = {"n": {"a": 4, "b": 2}, "train": {"a"}, "val": {"b"}}
    g = pd.factorize(pd.Series(["b", "a", "c", None, "a"]))  # the held-out condition and a row without one weigh nothing
    assert M._weights(g, fit, "train").tolist() == [0, 0.25, 0, 0, 0.25] and M._weights(g, fit, "val").tolist() == [0.5, 0, 0, 0, 0]
