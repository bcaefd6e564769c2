"""Edge cases and comparisons with pandas and NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import scalars, texts
from gaugeline.operators import catalog, mixture, nearby, quantiles, sampling, series, thresholds, timeline, vectors

FAILS = {"Error": True, "errors": False, "stage_error_1": True, "NOT OK": True, "not-ok": True, "x-NOK": True, "failover": False, "Fehler": True, "": False, None: None}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_failure_words(spark):
    rows = frame(spark, [(k,) for k in FAILS], "m string").select("m", texts.is_failure(F.col("m")).alias("f")).collect()
    assert {r["m"]: r["f"] for r in rows} == FAILS


def test_stage_numbers(spark):
    rows = frame(spark, [(" 2 ",), ("+3",), ("1.0",), ("4",), ("0",), ("x",), (None,)], "m string").select(texts.stage_number(F.col("m"), 3)).collect()
    assert [r[0] for r in rows] == [2, 3, None, None, None, None, None]


def test_manifest_cases(spark):
    bags = frame(spark, [("a", 5, True), ("b", 2, False), ("c", 3, True), ("d", 4, True)], "run_id string, message_count long, has_markers boolean")
    events = frame(spark, [("a", 1, 0.5, "Error"), ("a", 2, 1.0, " ok "), ("d", 1, 1.0, "NOK"), ("d", 2, 1.0, "1")], "run_id string, seq long, time double, marker string")
    got = {r["run_id"]: r for r in catalog.manifest(bags, events, 1.0).collect()}
    assert {k: r["label"] for k, r in got.items()} == {"a": "normal", "b": "unknown", "c": "unknown", "d": "fail"}
    assert got["a"]["ignored_startup_markers"] == "0.500000s:Error" and got["a"]["used_stage_markers"] == "1.000000s:ok"
    assert got["b"]["used_stage_markers"] == "<stage topic missing>" and got["c"]["used_stage_markers"] == ""
    assert got["d"]["failure_markers"] == "1.000000s:NOK" and got["d"]["used_stage_markers"] == "1.000000s:NOK | 1.000000s:1"


@pytest.mark.parametrize(
    ("marks", "starts", "source"),
    [
        ([(0.1, "1"), (0.2, "2"), (0.3, "3"), (1, "1"), (4, "2"), (7, "3")], [1, 4, 7], "recorded"),
        ([(1, "1"), (7, "3")], [0, 10 / 3, 20 / 3], "equal_intervals"),
        ([(4, "2"), (5, "1"), (7, "3")], [0, 10 / 3, 20 / 3], "equal_intervals"),
        ([(1, "1"), (4, "2"), (10, "3")], [0, 10 / 3, 20 / 3], "equal_intervals"),
        ([(1, "1"), (4, "2"), (4.05, "3")], [0, 10 / 3, 20 / 3], "equal_intervals"),
        ([(1, "1"), (4, "2"), (4.06, "3"), (5, "Error")], [1, 4, 4.06], "recorded"),
        ([], [0, 10 / 3, 20 / 3], "equal_intervals"),
    ],
)
def test_timeline(spark, marks, starts, source):
    events = frame(spark, [("r", float(t), m) for t, m in marks], "run_id string, time double, marker string")
    row = timeline.stage_timeline(events, frame(spark, [("r", 10.0)], "run_id string, end_sec double")).first()
    assert row["source"] == source and np.allclose(row["starts"], starts)


def test_locate_and_latest_marker(spark):
    line = frame(spark, [("r", 10.0, [1.0, 4.0, 4.0], "recorded")], "run_id string, end_sec double, starts array<double>, source string")
    points = frame(spark, [("r", t) for t in (-1.0, 1.0, 2.5, 4.0, 12.0)], "run_id string, time double")
    got = {r["time"]: (r["stage"], r["progress"]) for r in timeline.locate(points, line).collect()}
    assert got == {-1.0: (1, 0.0), 1.0: (1, 0.0), 2.5: (1, pytest.approx(1 / 6)), 4.0: (3, pytest.approx(2 / 3)), 12.0: (3, 1.0)}
    marks = frame(spark, [("r", 1.0, 1, "a"), ("r", 4.0, 2, "b"), ("r", 4.0, 3, "c")], "run_id string, time double, seq long, marker string")
    got = {r["time"]: r["latest_marker"] for r in timeline.latest_marker(points, marks).collect()}
    assert got == {-1.0: None, 1.0: "a", 2.5: "a", 4.0: "c", 12.0: "c"}


def greedy(times, fps, start=0.0):
    due, out = start, []
    for k, t in enumerate(times):
        if t >= start and t + 1e-9 >= due:
            out.append(k)
            while due <= t:
                due += 1.0 / fps
    return out


@pytest.mark.parametrize(("fps", "start"), [(2, 0.0), (1, 0.0), (4, 0.25), (3, 0.0), (5, 0.0), (10, 0.5), (0.7, 0.0)])
def test_sampling_follows_the_sums(spark, fps, start):
    times = [round(k / 30, 9) for k in range(900)] + [31.0, 31.0, 45.2]
    rows = frame(spark, [("r", t, k) for k, t in enumerate(times)], "run_id string, time double, seq long")
    got = sampling.sample_at_rate(rows, fps, start).orderBy("frame_id").collect()
    assert [r["seq"] for r in got] == greedy(times, fps, start)
    assert [r["frame_id"] for r in got] == list(range(len(got)))


def test_sampling_takes_early_frames_and_at_most_as_many(spark):
    """A frame less than a nanosecond early is taken, and so is the next one."""
    times = [0.0, 0.1, 0.3 - 5e-10, 0.3, 0.31, 0.6 - 2e-9, 0.6 - 4e-10, 0.6 + 1e-12, 0.7, 0.9000000001, 30.0, 30.0]
    rows = frame(spark, [(run, t, k) for run in "ab" for k, t in enumerate(times[: 12 if run == "a" else 5])], "run_id string, time double, seq long")
    got = sampling.sample_at_rate(rows, 1 / 0.3).orderBy("run_id", "frame_id").collect()
    assert [(r["run_id"], r["seq"]) for r in got] == [("a", k) for k in greedy(times, 1 / 0.3)] + [("b", k) for k in greedy(times[:5], 1 / 0.3)]
    assert [r["seq"] for r in sampling.sample_at_rate(rows, 1 / 0.3, most=2).orderBy("run_id", "frame_id").collect()] == [k for n in (12, 5) for k in greedy(times[:n], 1 / 0.3)[:2]]
    assert sampling.sample_at_rate(rows.limit(0), 3.0).count() == 0


def test_sampling_counts_on_the_grid(spark):
    rows = spark.range(1800).select(F.lit("r").alias("run_id"), F.round(F.col("id") / 30, 9).alias("time"), F.col("id").alias("seq"))
    assert [sampling.sample_at_rate(rows, f).count() for f in (2, 5, 10)] == [120, 439, 1039]


@pytest.mark.parametrize(("n", "k"), [(1, 4), (3, 7), (10, 1), (10, 4), (12, 5), (6, 6)])
def test_even_sampling(spark, n, k):
    rows = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("double").alias("time"), F.col("id").alias("seq"))
    want = sorted({int(round(p)) for p in np.linspace(0, n - 1, min(k, n))})
    assert sorted(r["position"] for r in sampling.sample_evenly(rows, k).collect()) == want


def test_fill_and_resample(spark):
    rng = np.random.default_rng(3)
    for n in (2, 7, 40, 90):
        v = rng.normal(size=n)
        v[rng.random(n) < 0.4] = np.nan
        v[rng.integers(n)] = 1.5
        rows = frame(spark, [("r", float(i), i, float(x)) for i, x in enumerate(v)], "run_id string, time double, seq long, v double")
        full = pd.Series(v).interpolate().bfill().ffill().to_numpy()
        got = series.fill_gaps(rows, ["v"]).orderBy("time").toPandas()["v"].to_numpy()
        assert np.allclose(got, full)
        got = series.resample(series.fill_gaps(rows, ["v"]), ["v"], 40).orderBy("sample").toPandas()
        assert np.allclose(got["v"], np.interp(np.linspace(0, 1, 40), np.linspace(0, 1, n), full)) and np.allclose(got["phase"], np.linspace(0, 1, 40))


def segment(t, x, padding=0.5):
    n = len(x)
    base = x[: min(n, max(20, int(n * 0.1)))]
    clean = base[base <= np.quantile(base, 0.75)]
    clean = base if len(clean) < min(10, len(base)) else clean
    m = np.median(clean)
    s = 1.4826 * np.median(np.abs(clean - m))
    s = np.std(clean) if s < 1e-6 else s
    thr = m + max(4 * s, 0.5)
    on = np.flatnonzero(x > thr)
    return (m, s, thr, bool(len(on)), max(t[0], t[on[0]] - padding) if len(on) else t[0], min(t[-1], t[on[-1]] + padding) if len(on) else t[-1])


@pytest.mark.parametrize("kind", ["burst", "none", "constant", "short", "ends"])
def test_active_segment(spark, kind):
    rng = np.random.default_rng(5)
    n = 12 if kind == "short" else 300
    t, x = np.arange(n) / 10, rng.normal(1, 0.05, n)
    x[n // 3 : n // 2] += {"burst": 5, "ends": 5}.get(kind, 0)
    if kind == "constant":
        x[:] = 2.0
    if kind == "ends":
        x[-3:] += 9
    rows = frame(spark, [("r", float(a), i, float(b)) for i, (a, b) in enumerate(zip(t, x))], "run_id string, time double, seq long, force_mag double")
    row = series.active_segment(rows).first()
    want = segment(t, x)
    assert row["active_found"] == want[3] and np.allclose([row[c] for c in ("baseline_median", "baseline_std", "threshold", "start_time", "end_time")], [*want[:3], *want[4:]])
    kept = series.trim(rows, series.active_segment(rows)).toPandas()
    inside = (t >= want[4]) & (t <= want[5])
    assert len(kept) == (n if inside.sum() < 20 else inside.sum()) and kept["time"].min() == 0
    assert kept["used_full_trajectory"].iloc[0] == (inside.sum() < 20)


def binned(p, s, bins, q, margin, least, floor, smooth):
    edges = np.linspace(0, 1, bins + 1)
    out = []
    for b in range(bins):
        m = (p >= edges[b]) & ((p < edges[b + 1]) | ((b == bins - 1) & (p <= edges[b + 1])))
        out.append(np.quantile(s[m], q) * margin if m.sum() >= least else np.nan)
    v = pd.Series(out).interpolate().bfill().ffill().fillna(np.quantile(s, q) * margin)
    v = pd.Series(np.maximum(v, np.quantile(s, floor)))
    return v.rolling(smooth, center=True, min_periods=1).median().to_numpy()


@pytest.mark.parametrize("n", [3, 40, 2000])
def test_binned_threshold(spark, n):
    rng = np.random.default_rng(n)
    p, s = np.round(rng.random(n) ** 2, 2), rng.gamma(2, 1, n)
    p[0], p[1] = 1.0, 0.02
    rows = frame(spark, [(float(a), float(b)) for a, b in zip(p, s)], "phase double, mahalanobis double")
    got = thresholds.phase_threshold(rows).orderBy("phase_center").toPandas()
    assert np.allclose(got["threshold_mahalanobis"], binned(p, s, 50, 0.999, 1.6, 5, 0.8, 5)) and got["count"].sum() == n


@pytest.mark.parametrize("few", [0, 7, 4096])
def test_exact_quantiles(spark, few, monkeypatch):
    """All digits counted, some, or none: the same ranks."""
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), np.round(rng.normal(size=400), 1), [0.0, -0.0, 5e-324, -5e-324, np.inf, -np.inf] * 2])
    groups = [None if k % 50 == 0 else f"g{k % 3}" for k in range(len(values))]
    rows = spark.createDataFrame([(g, None if k % 41 == 0 else float(v)) for k, (g, v) in enumerate(zip(groups, values))] + [("g9", 1.5), ("g8", None), ("g1", float("nan"))], "g string, x double").repartition(3)
    asked = {"low": 0.0, "q": 0.31, "mid": 0.5, "high": 0.99, "top": 1.0}
    held = {}
    for k, (g, v) in enumerate(zip(groups, values)):
        if g is not None and k % 41:
            held.setdefault(g, []).append(v)

    def same(a, b):
        return (np.isnan(a) and np.isnan(b)) or a == b or np.isclose(a, b, rtol=1e-12)

    with np.errstate(invalid="ignore", over="ignore"):
        got = {r["g"]: r for r in quantiles.exact_quantiles(rows, "x", asked, by="g").collect()}
        assert set(got) == {"g0", "g1", "g2", "g9"} and got["g9"]["mid"] == 1.5
        for g, x in held.items():
            assert got[g]["n"] == len(x) and all(same(got[g][name], np.quantile(x, f)) for name, f in asked.items())
        whole = quantiles.exact_quantiles(rows.where("g is not null"), "x", asked).first()
        x = [v for vs in held.values() for v in vs] + [1.5]
        assert whole["n"] == len(x) and all(same(whole[name], np.quantile(x, f)) for name, f in asked.items())
    assert quantiles.exact_quantiles(rows.limit(0), "x", asked).count() == 0
    keys = quantiles.order_keys(np.sort(values))
    assert (np.diff(keys) >= 0).all() and (quantiles.key_values(keys) == np.sort(values)).all()


def test_components_and_bins_without_rows(spark):
    rows = frame(spark, [(0, 3.0), (0, 5.0), (2, 1.0)], "component int, mahalanobis double")
    got = {r["component"]: r["limit"] for r in mixture.component_limits(rows, 4, 1.1).collect()}
    assert got == pytest.approx({0: 5.5, 1: 5.5, 2: 1.1, 3: 5.5})
    scores = frame(spark, [(p / 100 + 0.005, 1.0 + p) for p in range(100) if not 40 <= p < 50], "phase double, mahalanobis double")
    curve = thresholds.phase_threshold(scores, bins=10, quantile=0.5, margin=1.0, floor_quantile=None, smooth=None).orderBy("phase_center").collect()
    assert [r["count"] for r in curve] == [10] * 4 + [0] + [10] * 5 and curve[4]["threshold_mahalanobis"] == pytest.approx((curve[3]["threshold_mahalanobis"] + curve[5]["threshold_mahalanobis"]) / 2)
    none = thresholds.phase_threshold(scores.limit(0), bins=3).collect()
    assert [r["count"] for r in none] == [0, 0, 0]


def test_lookup_and_votes(spark):
    rng = np.random.default_rng(1)
    c = np.linspace(0.01, 0.99, 50)
    v = rng.gamma(3, 1, 50)
    p = np.concatenate([[0.0, 1.0, c[0], c[-1], c[7]], np.sort(rng.random(300))])
    s = rng.gamma(3, 1.5, len(p))
    table = frame(spark, [(float(a), float(b)) for a, b in zip(c, v)], "phase_center double, threshold_mahalanobis double")
    rows = frame(spark, [("r", i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, s))], "run_id string, index long, phase double, mahalanobis double")
    got = thresholds.apply_phase_threshold(rows, table).orderBy("index").toPandas()
    want = s / np.maximum(np.interp(p, c, v), 1e-8)
    smooth = pd.Series(want).rolling(11, center=True, min_periods=1).median()
    votes = (smooth > 1).astype(int).rolling(8, min_periods=1).sum() >= 6
    assert np.allclose(got["epsilon_adaptive"], want) and np.allclose(got["epsilon_smooth"], smooth) and (got["alarm_filtered"] == votes).all()
    with pytest.raises(ValueError):
        thresholds.apply_phase_threshold(rows, table, votes=9)


@pytest.mark.parametrize("w", [3, 4, 5, 8])
def test_rolling_median_of_any_width(spark, w):
    from pyspark.sql import Window as W

    x = np.random.default_rng(w).random(30)
    rows = frame(spark, [(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    got = rows.select("i", thresholds.rolling_median(F.col("x"), W.partitionBy(F.lit(0)).orderBy("i"), w).alias("m")).orderBy("i").toPandas()["m"]
    assert np.allclose(got, pd.Series(x).rolling(w, center=True, min_periods=1).median())


def test_mixture_fit_gains_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = []
    for run in range(3):
        ph = np.linspace(0, 1, 120)
        y = np.where(ph < 0.4, ph, np.where(ph < 0.7, 2 - ph, 3 * ph)) + rng.normal(0, 0.05, 120)
        rows += [(run, float(a), float(b), float(b * 2)) for a, b in zip(ph, y)]
    df = frame(spark, rows, "run_id long, phase double, u double, v double")
    model = mixture.fit(df, ["phase"], ["u", "v"], rounds=20)[None]
    x = np.array([r[1:] for r in rows])
    assert np.isclose(model.weights.sum(), 1) and np.allclose(model.shift, x.mean(0)) and np.allclose(model.scale, x.std(0))
    got = mixture.score(df, model).toPandas()
    distance, component = model.score(x)
    assert np.allclose(sorted(got["mahalanobis"]), sorted(distance))
    # a plain loop over one row, step by step
    z, k = model.scaled(x)[50], component[50]
    m, c, reg = model.means[k], model.covariances[k], model.reg
    inv = np.linalg.pinv(c[:1, :1] + reg * np.eye(1))
    cond = c[1:, 1:] - c[1:, :1] @ inv @ c[:1, 1:]
    cond = (cond + cond.T) / 2 + reg * np.eye(2)
    off = z[1:] - (m[1:] + c[1:, :1] @ inv @ (z[:1] - m[:1]))
    assert np.isclose(distance[50], np.sqrt(off @ np.linalg.pinv(cond + reg * np.eye(2)) @ off))
    assert (got["epsilon"] <= 1 / 1.1 + 1e-9).all() and not got["anomaly"].any()
    held = mixture.leave_one_out(df, ["phase"], ["u", "v"], rounds=10).toPandas()
    assert sorted(held["held_out_run"].unique()) == [0, 1, 2] and (held["held_out_run"] == held["run_id"]).all()
    # one after another: the same scales, and the same scores but for where the parts start
    for run, (n, mean, deviation) in mixture._scales(mixture.run_sums(df, ["phase", "u", "v"]), ["phase", "u", "v"], [0, 1, 2]).items():
        rest = np.array([r[1:] for r in rows if r[0] != run])
        assert n == len(rest) and np.allclose(mean, rest.mean(0)) and np.allclose(deviation, rest.std(0))
    alone = mixture.fit(df.where("run_id <> 1"), ["phase"], ["u", "v"], components=1, rounds=3)[None]
    one = mixture.leave_one_out(df, ["phase"], ["u", "v"], components=1, rounds=3).where("run_id = 1").toPandas()
    assert np.allclose(one["mahalanobis"], alone.score(one[["phase", "u", "v"]].to_numpy())[0])
    assert np.allclose(one["component_threshold"], alone.limits[0])
    with pytest.raises(ValueError):
        mixture.leave_one_out(df.where("run_id = 0"), ["phase"], ["u"])
    # tiles of one run or of all: a model does not depend on those beside it
    tiles = [mixture.leave_one_out(df, ["phase"], ["u", "v"], models=n).orderBy("run_id", "phase").toPandas() for n in (1, 256)]
    assert np.allclose(tiles[0]["mahalanobis"], tiles[1]["mahalanobis"]) and (tiles[0]["component"] == tiles[1]["component"]).all()
    with pytest.warns(UserWarning, match="1 of 1 mixtures still gained after 2 rounds"):
        assert not mixture.fit(df, ["phase"], ["u", "v"], rounds=2)[None].converged


def test_one_component_leave_one_out_starts_no_fit(spark, monkeypatch):
    """The moments of all runs less a run's own: the same scores as fits, run by run, without one."""
    rng = np.random.default_rng(5)
    rows = [(run, int(k), float(a), float(a * 2 + run + rng.normal()), float(rng.normal() * (run + 1)), 4.0) for run in range(9) for k, a in enumerate(rng.random(3 + run * 4))]
    df = frame(spark, rows, "run_id long, seq int, phase double, u double, v double, same double").repartition(3)
    inputs, outputs = ["phase", "same"], ["u", "v"]
    want = {r: mixture.fit(df.where(f"run_id <> {r}"), inputs, outputs, components=1, limits=False)[None] for r in range(9)}

    def none(*_, **__):
        raise AssertionError("a fit was started")

    monkeypatch.setattr(mixture, "fit", none)
    got = mixture.leave_one_out(df, inputs, outputs, components=1, limits=False).toPandas()
    assert len(got) == len(rows) and (got["held_out_run"] == got["run_id"]).all() and (got["component"] == 0).all()
    for run, mine in got.groupby("run_id"):
        assert np.allclose(mine["mahalanobis"], want[run].score(mine[["phase", "same", "u", "v"]].to_numpy())[0])
    with pytest.raises(ValueError):
        mixture.leave_one_out(df.where("run_id = 0"), ["phase"], ["u"], components=1, limits=False)


def plain_mixture(x, components, starts, rounds=100, reg=1e-5, tolerance=1e-3):
    """The best mean log-likelihood of several starts by k-means++ and moved means, in plain NumPy."""
    best, d = -np.inf, x.shape[1]
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        seeds = [x[rng.integers(len(x))]]
        while len(seeds) < components:
            apart = ((x[:, None] - np.array(seeds)) ** 2).sum(2).min(1)
            seeds.append(x[rng.choice(len(x), p=apart / apart.sum())])
        seeds = np.array(seeds)
        for _ in range(50):
            own = ((x[:, None] - seeds) ** 2).sum(2).argmin(1)
            seeds = np.array([x[own == k].mean(0) if (own == k).any() else seeds[k] for k in range(components)])
        r, last = np.eye(components)[own], -np.inf
        for _ in range(rounds):
            n = r.sum(0) + 1e-15
            means = r.T @ x / n[:, None]
            cov = [((r[:, k, None] * (x - means[k])).T @ (x - means[k])) / n[k] + reg * np.eye(d) for k in range(components)]
            log = np.stack([np.log(n[k] / n.sum()) - 0.5 * (d * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", x - means[k], np.linalg.inv(c), x - means[k])) for k, c in enumerate(cov)], axis=1)
            top = log.max(1)
            now = (top + np.log(np.exp(log - top[:, None]).sum(1))).mean()
            r = np.exp(log - top[:, None])
            r /= r.sum(1, keepdims=True)
            if abs(now - last) < tolerance:
                break
            last = now
        best = max(best, now)
    return best


def test_seeded_start_is_as_likely_as_plain_restarts(spark):
    """Clusters that equal parts by the first column cut across."""
    rng = np.random.default_rng(12)
    centres = np.array([[0, 6], [0.3, -6], [0.1, 0], [5, 1]])
    x = centres[rng.integers(0, 4, 500)] + rng.normal(0, 0.4, (500, 2))
    df = frame(spark, [(k % 3, float(a), float(b)) for k, (a, b) in enumerate(x)], "run_id long, phase double, u double").repartition(3)
    found = mixture.fit(df, ["phase"], ["u"], components=4, start="seeds", restarts=5)[None]
    z = (x - x.mean(0)) / x.std(0)
    assert found.converged and found.likelihood >= plain_mixture(z, 4, 5) - 0.02
    again = mixture.fit(df.repartition(2), ["phase"], ["u"], components=4, start="seeds", restarts=5)[None]
    assert np.isclose(again.likelihood, found.likelihood) and found.likelihood >= mixture.fit(df, ["phase"], ["u"], components=4)[None].likelihood - 1e-9
    held = mixture.leave_one_out(df, ["phase"], ["u"], components=4, start="seeds", restarts=2)
    assert held.count() == 500 and held.where("mahalanobis is null").count() == 0


def test_many_held_out_mixtures_share_their_passes(spark, monkeypatch):
    """300 runs are one tile: a pass a round for all models, each of which is that of a fit without the run."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (1200, 2)) * [1, 3] + np.array([[-4, 50], [0, 40], [4, 60]])[rng.integers(0, 3, 1200)]
    df = frame(spark, [(k % 300, float(a), float(b)) for k, (a, b) in enumerate(x)], "run_id long, phase double, u double").repartition(3)
    passes, moments = [], mixture._moments
    monkeypatch.setattr(mixture, "_moments", lambda *args: passes.append(len(args[2])) or moments(*args))
    got = mixture.leave_one_out(df, ["phase"], ["u"], rounds=4, tolerance=0, limits=False).toPandas()
    assert passes == [300] * 4 and len(got) == 1200
    monkeypatch.undo()
    cuts = mixture.exact_quantiles(df, "phase", {"a": 1 / 3, "b": 2 / 3}).first()
    for run in (0, 17, 299):
        kept, own = x[np.arange(1200) % 300 != run], x[np.arange(1200) % 300 == run]
        z, r = (kept - kept.mean(0)) / kept.std(0), np.eye(3)[np.searchsorted([cuts["a"], cuts["b"]], kept[:, 0], side="right")]
        for _ in range(4):
            n = r.sum(0)
            means = r.T @ z / n[:, None]
            covariances = np.array([(r[:, k, None] * (z - means[k])).T @ (z - means[k]) / n[k] + mixture.REG * np.eye(2) for k in range(3)])
            log = np.stack([np.log(n[k] / n.sum()) + mixture._log_density(z, means[k], covariances[k], 0.0) for k in range(3)], axis=1)
            r = np.exp(log - log.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
        model = mixture.Mixture(["phase"], ["u"], n / n.sum(), means, covariances, kept.mean(0), kept.std(0))
        distance, component = model.score(own)
        mine = got[got.run_id == run].sort_values("phase")
        order = np.argsort(own[:, 0])
        assert np.allclose(mine.mahalanobis, distance[order], atol=1e-8) and list(mine.component) == list(component[order])


def test_sums_near_a_mixture_follow_from_its_own():
    """What a series gives for mixtures near a centre is what the rows give, up to the bound that it states."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    terms, before = mixture._terms(x).T, None
    centre = rng.normal(size=(3, 10)) * 0.4
    for order in (3, 5, 7):
        near = nearby.Series(3, 3, order)
        found = near.centre((near.sums(x[:250], centre[:, :, None]) + near.sums(x[250:], centre[:, :, None]))[0], centre, np.abs(terms).max(axis=1))
        off = rng.normal(size=(3, 10, 40)) * np.logspace(-5, -2.3, 40)
        sums, likelihood, bound = near.near([found], centre[:, :, None] + off)
        for k in range(40):
            share, level = nearby.shares((centre + off[:, :, k]) @ terms)
            rounding = 1e-9
            assert np.abs(share @ terms.T - sums[:, :, k]).max() <= bound[k] + rounding and abs(level.sum() - likelihood[k]) <= bound[k] + rounding
        assert np.isfinite(bound).all() and (np.diff(bound[::8]) > 0).all() and (before is None or bound[20] < before / 10)
        before = bound[20]
        assert near.near([found], centre[:, :, None] + 10 * rng.normal(size=(3, 10, 1)))[2][0] == np.inf


def test_held_out_mixtures_near_centres_need_no_fit(spark, monkeypatch):
    """Most of 900 runs get the mixture that a fit over the other rows gives, without that fit."""
    rng = np.random.default_rng(21)
    x = rng.uniform(-1.5, 1.5, (5400, 2)) * [1, 3] + np.array([[-4, 50], [0, 40], [4, 60]])[rng.integers(0, 3, 5400)]
    df = frame(spark, [(k % 900, k, float(a), float(b)) for k, (a, b) in enumerate(x)], "run_id long, seq long, phase double, u double").repartition(3)
    # and a run that a task should not hold
    df = df.unionByName(df.where("run_id < 10").withColumns({"run_id": F.lit(-1), "seq": F.col("seq") + 10_000}))
    fit, held = mixture.fit, []
    monkeypatch.setattr(mixture, "fit", lambda *args, hold_out, **options: held.extend(hold_out) or fit(*args, hold_out=hold_out, **options))

    def scored(few, **options):
        held.clear()
        for name, value in {"FEW": few, "FEW_PAIRS": 0, "LONG": 50}.items():
            monkeypatch.setattr(mixture, name, value, raising=False)
        return mixture.leave_one_out(df, ["phase"], ["u"], limits=False, **options).orderBy("seq").toPandas()

    want = scored(1000)
    assert len(held) == 901
    got = scored(30)
    assert -1 in held and 1 < len(held) < 200 and len(got) == 5460 and list(got.columns) == list(want.columns)
    assert (got.held_out_run == got.run_id).all() and (got.component == want.component).all()
    assert np.allclose(got.mahalanobis, want.mahalanobis, rtol=0, atol=1e-9)
    # the same mixtures where some settle rounds after others, or none does
    for options in ({"tolerance": 1e-5}, {"tolerance": 0, "rounds": 4}):
        want, got = scored(1000, **options), scored(30, **options)
        assert (got.component == want.component).all() and np.allclose(got.mahalanobis, want.mahalanobis, rtol=0, atol=1e-9)
    with pytest.warns(UserWarning, match="of 901 mixtures still gained after 2 rounds"):
        assert len(scored(30, rounds=2)) == 5460 and len(held) < 200


@pytest.mark.parametrize(("block", "most"), [(7, 0), (4096, 0), (7, 1 << 25)])
def test_nearest_in_blocks(spark, block, most):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5] = v[9]
    m = frame(spark, [(i, x.tolist(), i % 4, i % 3) for i, x in enumerate(v)], "item_id long, cls array<double>, group int, stage int")
    got = vectors.nearest(m.withColumnRenamed("item_id", "query_id"), m, 4, by_stage=True, apart=True, block=block, pivots=4, broadcast_bytes=most).toPandas()
    for q in range(60):
        far = sorted((round(1 - v[q] @ v[i], 12), i) for i in range(60) if i % 3 == q % 3 and i % 4 != q % 4)[:4]
        assert got[got["query_id"] == q].sort_values("rank")["item_id"].tolist() == [i for _, i in far]


def test_nearest_leaves_far_cells_out(spark):
    """Vectors in clusters: the same rows as comparing all, from a part of the pairs; lengths differ, ties go by id."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = centres[rng.integers(0, 12, 900)] + 0.02 * rng.normal(size=(900, 16))
    v[:300] /= np.linalg.norm(v[:300], axis=1, keepdims=True)
    v[40] = v[41] = v[42]
    m = frame(spark, [(i, x.tolist(), i % 5) for i, x in enumerate(v)] + [(5000, None, 1)], "item_id long, cls array<double>, group int")
    q = m.where("item_id % 3 = 0 OR item_id = 5000").withColumnRenamed("item_id", "query_id")
    got = vectors.nearest(q, m, 3, apart=True, block=50, pivots=12, broadcast_bytes=0).toPandas()
    far = 1 - v @ v.T
    far[np.arange(900)[:, None] % 5 == np.arange(900) % 5] = np.inf
    for i in range(0, 900, 3):
        want = sorted(range(900), key=lambda j: (round(far[i, j], 12), j))[:3]
        assert got[got["query_id"] == i].sort_values("rank")["item_id"].tolist() == want
    assert len(got) == 900
    share = vectors.compared_share(q, m, 3, apart=True, block=50, pivots=12).first()
    assert share["pairs"] == 300 * 900 and share["share"] < 0.6
    for most in (0, 1 << 25):
        assert vectors.nearest(q, m.limit(0), 3, broadcast_bytes=most).count() == 0


def test_nearest_moves_each_vector_once(spark):
    """Pairs of blocks are read where they lie: no exchange of the plan copies a vector for each block it meets."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 8))
    m = frame(spark, [(i, x.tolist(), i % 5) for i, x in enumerate(v)], "item_id long, cls array<double>, group int")
    found = vectors.nearest(m.withColumnRenamed("item_id", "query_id"), m, 3, apart=True, block=20, pivots=6, broadcast_bytes=0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan
    far = 1 - v @ v.T
    far[np.arange(400)[:, None] % 5 == np.arange(400) % 5] = np.inf
    got = found.orderBy("query_id", "rank").toPandas()
    assert got["item_id"].tolist() == np.argsort(far, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_weights_check_their_arguments():
    for bad in ({"power": 0}, {"least": 1.5}):
        with pytest.raises(ValueError):
            scalars.attention_weights(F.lit(1), F.lit(1), **bad)


def test_frame_score(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 5, 4))
    p, q = rng.random((2, 5))
    c = np.maximum(p, q)
    w = 0.15 + 0.85 * ((c - c.min()) / (c.max() - c.min() + 1e-8)) ** 1.5
    s = np.sqrt(((a - b) ** 2).mean(-1))
    row = frame(spark, [(a.tolist(), b.tolist(), p.tolist(), q.tolist())], "a array<array<double>>, b array<array<double>>, p array<double>, q array<double>")
    assert np.isclose(row.select(vectors.frame_score(F.col("a"), F.col("p"), F.col("b"), F.col("q"))).first()[0], (s * w).sum() / w.sum())
    flat = row.select(vectors.frame_score(F.col("a"), F.array(*[F.lit(1.0)] * 5), F.col("b"), F.array(*[F.lit(1.0)] * 5))).first()[0]
    assert np.isclose(flat, s.mean())


def test_missing_columns_and_topics_are_named(spark):
    rows = frame(spark, [("r", "a", "x")], "run_id string, topic string, message_type string")
    with pytest.raises(ValueError, match="time"):
        series.fill_gaps(rows, ["v"])
    with pytest.raises(ValueError, match="'a'"):
        catalog.require_topic(rows, "b")
    with pytest.raises(TypeError):
        catalog.require_topic(rows, "a", {"y"})


def test_nearest_tells_single_precision_apart(spark):
    """Distances that differ by less than single precision shows come out in their order, and copies tie by id in any block."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(30, 16)) * np.array([[1.0], [1e3], [1e-3]]).repeat(10, axis=0)
    v = np.concatenate([u[i // 8] * (1 + 1e-11 * (i % 8)) for i in range(240)]).reshape(240, 16)
    v = np.concatenate([v, u, u, 1e20 * u[:2]])  # copies, and numbers beyond the squares of single precision
    m = frame(spark, [(i, x.tolist(), i % 3) for i, x in enumerate(v)], "item_id long, cls array<double>, group int")
    got = vectors.nearest(m.withColumnRenamed("item_id", "query_id"), m, 4, apart=True, block=40, pivots=5, broadcast_bytes=0).orderBy("query_id", "rank").toPandas()
    far = 1.0 - np.array([np.einsum("ij,ij->i", np.broadcast_to(x, v.shape), v) for x in v])
    far[np.arange(len(v))[:, None] % 3 == np.arange(len(v)) % 3] = np.inf
    assert got["item_id"].tolist() == np.argsort(far, axis=1, kind="stable")[:, :4].ravel().tolist()
