"""Mixture regression: how far outputs are from what the inputs tell.

A Gaussian mixture over inputs and outputs together is fitted by sums: in each
round every partition adds up responsibilities, first and second moments for
all models at once (with leave-one-out, one model a held-out run), and the
driver gets their sums, K * (1 + d + d*(d+1)/2) numbers a model.  A log density
is a weighted sum of a row's terms (1, columns, products of two), so densities
of many rows under all models, and the sums, are products of matrices.  Every model stops by itself, so
what it becomes does not depend on the models that share its passes.

Leave-one-out goes by tiles of runs: scales of its models come from sums of all
runs less the run's own, which are written once; the models of a tile are
fitted, score the rows of its runs, and are gone before the next tile, so
neither the driver nor a task ever holds more than a tile's models.  The passes
over the rows grow with the tiles, as each held-out run asks for a fit of its own.

Of many runs most leave models that hardly differ.  Their sums over all rows
follow from those at one model near them (``nearby``), within a bound that is
computed for each (``OFF``), so a task takes such a run through all its rounds
with the run's own rows alone, and tiles are for the runs that no centre is near.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.operators.catalog import need
from gaugeline.operators.nearby import Centre, Series, order_of, shares
from gaugeline.operators.quantiles import exact_quantiles
from gaugeline.sources.shared import fresh_path, settle

REG = 1e-5
#: Fixed values of the density where a matrix has no positive determinant, and the least weight in a logarithm.
SINGULAR_REG, LEAST_DETERMINANT, LEAST_WEIGHT = 1e-4, 1e-12, 1e-12
#: Leave-one-out models that are fitted together, about.
MODELS = 2048
#: Numbers of a matrix of rows and models in a task, and models whose sums travel together.
CELLS, TOGETHER = 1 << 17, 64
#: Left-out mixtures, and pairs of one and a row, up to which they are fitted over the rows; the most centres of others at once.
FEW, FEW_PAIRS, CENTRES = 1024, 1 << 28, 8
#: Rows of the longest run that a task holds whole, and about those of its group.
LONG, GROUP = 1 << 17, 50_000
#: What the sums of a mixture near a centre may be off by, a row; least variance, of all rows' 1, of the rows that a run leaves.
OFF, LEAST_VARIANCE = 1e-12, 1e-6
#: What became of a run's mixture: settled, out of rounds, not settled in the rounds so far, too far from all centres.
SETTLED, STOPPED, LATER, FAR = range(4)
#: Rounds of moving seeds to the means of their rows before the first round of a mixture.
MOVES = 3


@dataclass
class Mixture:
    """Weights, means and covariances of scaled columns; limits of components."""

    inputs: list[str]
    outputs: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    reg: float = REG
    limits: dict[int, float] = field(default_factory=dict)
    #: Rounds of the fit, the mean log-likelihood in its last one, and whether it had stopped to gain.
    rounds: int = 0
    likelihood: float = -np.inf
    converged: bool = False

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.inputs, *self.outputs]))

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.shift) / self.scale

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each row's outputs from their prediction, and the component that predicts.

        The regularization is added where the mixture is fitted, and again to
        every matrix that is inverted, and to the conditional covariance.
        """
        x = self.scaled(rows)
        a = [self.columns.index(c) for c in self.inputs]
        b = [self.columns.index(c) for c in self.outputs]
        density = np.stack([np.log(w + LEAST_WEIGHT) + _log_density(x[:, a], m[a], c[np.ix_(a, a)], self.reg) for w, m, c in zip(self.weights, self.means, self.covariances)])
        component = density.argmax(axis=0)
        distance = np.empty(len(x))
        for k in range(len(self.weights)):
            mine = component == k
            m, c = self.means[k], self.covariances[k]
            gain = c[np.ix_(b, a)] @ _inverse(c[np.ix_(a, a)], self.reg)
            rest = c[np.ix_(b, b)] - gain @ c[np.ix_(a, b)]
            rest = 0.5 * (rest + rest.T) + np.eye(len(b)) * self.reg
            off = x[mine][:, b] - (m[b] + (x[mine][:, a] - m[a]) @ gain.T)
            distance[mine] = np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", off, _inverse(rest, self.reg), off), 0))
        return distance, component


def _inverse(matrix: np.ndarray, reg: float) -> np.ndarray:
    return np.linalg.pinv(matrix + np.eye(len(matrix)) * reg)


def _precision(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse and log determinant of a matrix, or of each of a stack."""
    sign, log_det = np.linalg.slogdet(matrix)
    if np.any(sign <= 0):
        lifted = np.linalg.det(matrix + np.eye(matrix.shape[-1]) * SINGULAR_REG)
        log_det = np.where(sign > 0, log_det, np.log(np.maximum(lifted, LEAST_DETERMINANT)))
    return np.linalg.pinv(matrix), log_det


def _log_density(x: np.ndarray, mean: np.ndarray, covariance: np.ndarray, reg: float) -> np.ndarray:
    d = len(mean)
    inverse, log_det = _precision(covariance + np.eye(d) * reg)
    off = x - mean
    return -0.5 * (d * np.log(2 * np.pi) + log_det + np.einsum("ni,ij,nj->n", off, inverse, off))


def scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of columns in one row."""
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


@dataclass
class _Job:
    """A mixture in the making: the run it leaves out, its scales, where it starts, and what it is so far."""

    key: object
    rows: int
    shift: np.ndarray
    scale: np.ndarray
    #: Cuts of the first column, or seeds (components x columns), both scaled.
    begin: np.ndarray
    model: Mixture | None = None

    def kept(self, part: pd.DataFrame, raw: np.ndarray) -> np.ndarray:
        return ((raw if self.key is None else raw[(part["run_id"] != self.key).to_numpy()]) - self.shift) / self.scale

    def begun(self, x: np.ndarray, components: int) -> np.ndarray:
        """Shares of the components in each row before the first round."""
        if self.begin.ndim == 1:
            return np.eye(components)[np.searchsorted(self.begin, x[:, 0], side="right")]
        return np.eye(components)[_squares(x, self.begin).argmin(axis=1)]


def _squares(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - seeds[None, :, :]) ** 2).sum(axis=2)


def _terms(x: np.ndarray) -> np.ndarray:
    """One, the columns, and the products of two of them."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _moved(jobs: list[_Job], shift: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands that turn rows in common scales into those of each job."""
    own = np.stack([job.scale for job in jobs])
    return scale / own, (shift - np.stack([job.shift for job in jobs])) / own


def _forms(weights: np.ndarray, means: np.ndarray, covariances: np.ndarray, factor: np.ndarray, summand: np.ndarray) -> list[np.ndarray]:
    """Of each component the weights (terms x models) that make its log density, with its share, of the terms of rows in common scales."""
    d = means.shape[-1]
    i, j = np.triu_indices(d)
    out = []
    for k in range(weights.shape[1]):
        inverse, log_det = _precision(covariances[:, k])
        inverse = inverse * factor[:, :, None] * factor[:, None, :]
        mean = (means[:, k] - summand) / factor
        pull = np.einsum("mij,mj->mi", inverse, mean)
        share = np.log(weights[:, k] + 1e-300)
        least = share - 0.5 * (d * np.log(2 * np.pi) + log_det + (mean * pull).sum(axis=1))
        out.append(np.ascontiguousarray(np.column_stack([least, pull, np.where(i == j, -0.5, -1.0) * inverse[:, i, j]]).T))
    return out


def _left_out(keys: list) -> Callable[[pd.Series], tuple[np.ndarray, np.ndarray]]:
    """Of rows by their run: the pairs of a row and a job (by its key) that leaves that run out."""
    jobs = np.array([k for k, key in enumerate(keys) if key is not None], int)
    code, known = pd.factorize(pd.Series([keys[k] for k in jobs]))
    jobs, count = jobs[np.argsort(code, kind="stable")], np.bincount(code, minlength=len(known))
    start = np.cumsum(count) - count

    def pairs(runs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        of = pd.Index(known).get_indexer(runs)
        rows = np.flatnonzero(of >= 0)
        n = count[of[rows]]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), jobs[np.repeat(start[of[rows]], n) + nth]

    return pairs


def _moments(rows: DataFrame, columns: list[str], jobs: list[_Job], components: int) -> list[tuple[np.ndarray, float]]:
    """Sums and log-likelihood of every job over the rows of the runs that it does not leave out."""
    d, shift, scale = len(columns), jobs[0].shift, jobs[0].scale
    begins = jobs if jobs[0].model is None else []
    (factor, summand), models = _moved(jobs, shift, scale), [job.model for job in jobs]
    forms = [] if begins else _forms(*(np.stack([getattr(m, name) for m in models]) for name in ("weights", "means", "covariances")), factor, summand)
    n, width, keys = len(jobs), 1 + d + d * (d + 1) // 2, [job.key for job in jobs]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, likelihood = np.zeros((components, width, n)), np.zeros(n)
        left_out, some = _left_out(keys), max(1, CELLS // n)
        for part in parts:
            raw = part[columns].to_numpy(dtype=float)
            terms = _terms((raw - shift) / scale)
            out_rows, out_jobs = left_out(part["run_id"])
            if begins:
                order = np.argsort(out_jobs, kind="stable")
                ends = np.searchsorted(out_jobs[order], np.arange(n + 1))
                for k, job in enumerate(begins):
                    share = job.begun((raw - job.shift) / job.scale, components)
                    share[out_rows[order[ends[k] : ends[k + 1]]]] = 0
                    total[:, :, k] += share.T @ terms
                continue
            cuts = np.searchsorted(out_rows, np.arange(0, len(part) + some, some))
            for b, a in enumerate(range(0, len(part), some)):
                t, at = terms[a : a + some], slice(cuts[b], cuts[b + 1])
                own = out_rows[at] - a, out_jobs[at]
                level = [t @ form for form in forms]  # rows x jobs, one a component
                top = level[0].copy()
                for x in level[1:]:
                    np.maximum(top, x, out=top)
                whole = np.zeros_like(top)
                for x in level:
                    x -= top
                    np.exp(x, out=x)
                    whole += x
                top += np.log(whole)
                np.reciprocal(whole, out=whole)
                # the run that a job leaves out adds nothing to it
                top[own] = whole[own] = 0
                likelihood += top.sum(axis=0)
                for k, x in enumerate(level):
                    x *= whole
                    total[k] += t.T @ x
        flat = np.concatenate([total.reshape(-1, n), likelihood[None]])
        groups = range(0, n, TOGETHER)
        yield pd.DataFrame({"first": groups, "sums": [flat[:, g : g + TOGETHER].tobytes() for g in groups]})

    used = rows.select("run_id", *columns).mapInPandas(run, "first int, sums binary")
    flat = np.zeros((components * width + 1, n))
    for r in used.groupBy("first").applyInArrow(_added, "first int, sums binary").collect():  # the sums of some jobs
        flat[:, r["first"] : r["first"] + TOGETHER] = np.frombuffer(r["sums"]).reshape(len(flat), -1)
    return list(zip(_own_scales(flat[:-1].T.reshape(n, components, width), factor, summand), flat[-1].tolist()))


def _added(group: pa.Table) -> pa.Table:
    added = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
    return pa.table({"first": group.column("first").slice(0, 1), "sums": pa.array([added.tobytes()], pa.binary())})


def _own_scales(sums: np.ndarray, factor: np.ndarray, summand: np.ndarray) -> np.ndarray:
    """Sums (models x components x terms) of rows in common scales, moved to those of each model, with whole matrices."""
    (n, components, _), d = sums.shape, factor.shape[1]
    count, x = sums[:, :, :1], sums[:, :, 1 : 1 + d] * factor[:, None, :]
    square = _full(sums[:, :, 1 + d :].reshape(n * components, -1), d).reshape(n, components, d, d) * (factor[:, :, None] * factor[:, None, :])[:, None]
    across = x[:, :, :, None] * summand[:, None, None, :]
    square += across + across.swapaxes(2, 3) + count[..., None] * (summand[:, :, None] * summand[:, None, :])[:, None]
    return np.concatenate([count, x + count * summand[:, None, :], square.reshape(n, components, d * d)], axis=2)


def _seeded(rows: DataFrame, columns: list[str], jobs: list[_Job], components: int, seed: int) -> None:
    """Start every job from rows drawn one after the other, each with a chance by its square distance to those before.

    A row's fixed random number u and square distance D make the key -ln(u) / D;
    the least key of all rows is such a draw, so a draw is one minimum a job.
    Seeds then move to the means of their rows a few times.
    """
    for job in jobs:
        job.begin = np.empty((0, len(columns)))
    for step in range(components):

        def draw(parts: Iterator[pd.DataFrame], step=step) -> Iterator[pd.DataFrame]:
            best: list = [(np.inf, None)] * len(jobs)
            for part in parts:
                raw = part[columns].to_numpy(dtype=float)
                for k, job in enumerate(jobs):
                    x = job.kept(part, raw)
                    h = part["_h"].to_numpy() if job.key is None else part["_h"].to_numpy()[(part["run_id"] != job.key).to_numpy()]
                    if len(x):
                        with np.errstate(over="ignore", divide="ignore"):
                            h = (h.view(np.uint64) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                            u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53
                            apart = _squares(x, job.begin).min(axis=1) if step else np.ones(len(x))
                            key = -np.log(np.maximum(u, 2.0**-54)) / apart
                        at = int(key.argmin())
                        if key[at] < best[k][0]:
                            best[k] = (float(key[at]), x[at].tolist())
            yield pd.DataFrame([(k, *b) for k, b in enumerate(best) if b[1] is not None], columns=["job", "key", "x"])

        salted = rows.select("run_id", *columns, F.xxhash64(*columns, F.lit(seed), F.lit(step)).alias("_h"))
        drawn = salted.mapInPandas(draw, "job int, key double, x array<double>").groupBy("job").agg(F.min_by("x", F.struct("key", "x")).alias("x"))
        found = {r["job"]: r["x"] for r in drawn.collect()}  # a row a job
        for k, job in enumerate(jobs):
            job.begin = np.vstack([job.begin, found.get(k, job.begin[-1] if len(job.begin) else np.zeros(len(columns)))])
    for _ in range(MOVES):
        for job, (sums, _) in zip(jobs, _moments(rows, columns, jobs, components)):
            some = sums[:, 0] > 0
            job.begin[some] = sums[some, 1 : 1 + len(columns)] / sums[some, :1]


def _from_sums(sums: np.ndarray, d: int, reg: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances by the sums of a model, or of each of a stack."""
    n = sums[..., 0] + 10 * np.finfo(float).eps
    means = sums[..., 1 : 1 + d] / n[..., None]
    second = sums[..., 1 + d :].reshape(*n.shape, d, d) / n[..., None, None]
    return n / n.sum(axis=-1, keepdims=True), means, second - means[..., :, None] * means[..., None, :] + np.eye(d) * reg


def fit(rows: DataFrame, inputs: list[str], outputs: list[str], components: int = 3, margin: float = 1.1, reg: float = REG, rounds: int = 60, tolerance: float = 1e-3, hold_out: list | None = None, start: str = "parts", restarts: int = 1, seed: int = 0, sums: DataFrame | None = None, limits: bool = True) -> dict:
    """Mixtures of nominal rows (run_id and columns): {None: model}, or one for each held-out run.

    ``start`` is "parts", equal parts by the first input column of all rows, or
    "seeds", drawn by distance as k-means++ draws them: of ``restarts`` of these
    the one of most likelihood is taken.  A model stops when its mean
    log-likelihood gains less than ``tolerance``; one that has not after
    ``rounds`` is given with ``converged`` false and a warning.  ``sums`` are
    those of ``run_sums``, if they are known already.  Without ``limits`` the
    components have none, which saves a pass.
    """
    columns = list(dict.fromkeys([*inputs, *outputs]))
    need(rows, "run_id", *columns)
    if start not in ("parts", "seeds"):
        raise ValueError(f"unknown start {start!r}")
    keys = [None] if hold_out is None else list(hold_out)
    parts = _parts(rows, columns[0], components) if start == "parts" else np.empty(0)
    jobs = []
    for key, (n, mean, deviation) in _scales(run_sums(rows, columns) if sums is None else sums, columns, keys).items():
        if not n:
            raise ValueError("at least one nominal row is needed")
        deviation[deviation == 0] = 1.0
        jobs += [_Job(key, n, mean, deviation, (parts - mean[0]) / deviation[0]) for _ in range(restarts if start == "seeds" else 1)]
    if start == "seeds":
        _seeded(rows, columns, jobs, components, seed)
    active = list(jobs)
    for turn in range(1, rounds + 1):
        for job, (found, likelihood) in zip(active, _moments(rows, columns, active, components)):
            before, now = job.model, likelihood / job.rows if job.model else -np.inf
            job.model = Mixture(inputs, outputs, *_from_sums(found, len(columns), reg), job.shift, job.scale, reg, rounds=turn, likelihood=now)
            job.model.converged = before is not None and bool(np.isfinite(now) and abs(now - before.likelihood) < tolerance)
        active = [job for job in active if not job.model.converged]
        if not active:
            break
    best: dict = {}
    for job in jobs:
        if job.key not in best or job.model.likelihood > best[job.key].likelihood:
            best[job.key] = job.model
    if late := [k for k, m in best.items() if not m.converged and tolerance > 0]:
        warnings.warn(f"{len(late)} of {len(best)} mixtures still gained after {rounds} rounds", stacklevel=2)
    models = list(best.items()) if limits else []
    for (_, model), found in zip(models, _limits(rows, columns, models, components, margin) if models else []):
        model.limits = found
    return best


def _parts(rows: DataFrame, column: str, components: int) -> np.ndarray:
    """Where a column is cut into equal parts, one a component."""
    cuts = {f"c{k}": k / components for k in range(1, components)}
    first = exact_quantiles(rows, column, cuts).first() if cuts else None
    return np.array([first[c] for c in cuts] if first else [], float)


def run_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, means and variances of the columns of each run: a row a run."""
    return rows.groupBy("run_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("_mean", F.avg), ("_var", F.var_pop))])


def _scales(sums: DataFrame, columns: list[str], keys: list) -> dict:
    """Count, means and population deviations of the rows of each model: one row of all, and one of each run left out."""
    n, weighted = F.col("_n"), lambda c: F.sum(F.col("_n") * c)
    mean = {c: weighted(F.col(f"_mean_{c}")) / F.sum(n) for c in columns}
    row = sums.agg(F.coalesce(F.sum(n), F.lit(0)), *mean.values()).first()
    total, mean = row[0], np.array([x or 0.0 for x in row[1:]])
    square = sums.agg(*[F.coalesce(weighted(F.col(f"_var_{c}") + (F.col(f"_mean_{c}") - float(m)) ** 2), F.lit(0.0)) for c, m in zip(columns, mean)]).first()
    square = np.array(list(square), float)
    out_runs = [k for k in keys if k is not None]
    own = {r["run_id"]: r for r in sums.where(F.col("run_id").isin(out_runs)).collect()} if out_runs else {}  # the runs left out
    out = {}
    for key in keys:
        r = own.get(key)
        n, m, v = (r["_n"], np.array([r[f"_mean_{c}"] for c in columns], float), np.array([r[f"_var_{c}"] for c in columns], float)) if r else (0, mean, np.zeros(len(columns)))
        left = total - n
        rest = mean - n * (m - mean) / max(left, 1)
        # squares about the mean of all rows, less the run's own, moved to the mean of the rest
        about = square - n * (v + (m - mean) ** 2) - left * (rest - mean) ** 2
        out[key] = (left, rest, np.sqrt(np.maximum(about, 0) / max(left, 1)))
    return out


def _limits(rows: DataFrame, columns: list[str], models: list, components: int, margin: float) -> list[dict[int, float]]:
    """The limits of the components of every model over the rows it was fitted to, from one pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = np.full((len(models), components), -np.inf)
        for part in parts:
            raw = part[columns].to_numpy(dtype=float)
            for k, (key, model) in enumerate(models):
                kept = raw if key is None else raw[(part["run_id"] != key).to_numpy()]
                if len(kept):
                    distance, component = model.score(kept)
                    np.maximum.at(most[k], component, distance)
        k, c = np.nonzero(np.isfinite(most))
        yield pd.DataFrame({"model": k, "component": c, "most": most[k, c]})

    seen = rows.select("run_id", *columns).mapInPandas(run, "model int, component int, most double").groupBy("model", "component").agg(F.max("most").alias("most"))
    found = np.full((len(models), components), -np.inf)
    for r in seen.collect():  # a row a model and component
        found[r["model"], r["component"]] = r["most"]
    whole = np.maximum(np.where(np.isfinite(found.max(axis=1)), found.max(axis=1), 1.0), 1e-6)
    filled = np.maximum(np.where(np.isfinite(found), found, whole[:, None]), 1e-6) * margin
    return [dict(enumerate(map(float, row))) for row in filled]


def component_limits(scores: DataFrame, components: int, margin: float) -> DataFrame:
    found = scores.groupBy("component").agg(F.max("mahalanobis").alias("most"))
    every = scores.sparkSession.range(components).select(F.col("id").cast("int").alias("component"))
    whole = scores.agg(F.greatest(F.coalesce(F.max("mahalanobis"), F.lit(1.0)), F.lit(1e-6)).alias("whole")).withColumn("_one", F.lit(1))
    joined = every.join(found, "component", "left").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")
    return joined.select("component", (F.greatest(F.coalesce("most", "whole"), F.lit(1e-6)) * margin).alias("limit"))


def score(rows: DataFrame, model: Mixture, limited: bool = True) -> DataFrame:
    """``rows`` with mahalanobis, component, component_threshold, epsilon and anomaly."""
    return _scored(rows, lambda part: [(np.arange(len(part)), model)], model.columns, limited)


def _scored(rows: DataFrame, models_of, columns: list[str], limited: bool = True) -> DataFrame:
    need(rows, *columns)
    added = "mahalanobis double, component int" + (", component_threshold double, epsilon double, anomaly boolean" if limited else "")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            raw, distance, component, limit = part[columns].to_numpy(dtype=float), np.empty(len(part)), np.empty(len(part), "int32"), np.empty(len(part))
            for at, model in models_of(part):
                if len(at):
                    distance[at], component[at] = model.score(raw[at])
                    if limited:
                        limit[at] = [model.limits[k] for k in component[at]]
            out = part.assign(mahalanobis=distance, component=component)
            if limited:
                out["component_threshold"] = limit
                out["epsilon"] = distance / np.maximum(limit, 1e-8)
                out["anomaly"] = out["epsilon"] > 1
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, {added}")


def _run_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, means and covariances of the columns of each run: a row a run."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy("run_id").agg(F.count("*").alias("_n"), F.array(*[F.avg(c) for c in columns]).alias("_mean"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_cov"))


def _full(upper: np.ndarray, d: int) -> np.ndarray:
    """Symmetric matrices from the rows of their upper halves."""
    out = np.empty((len(upper), d, d))
    i, j = np.triu_indices(d)
    out[:, i, j] = out[:, j, i] = upper
    return out


def _one_component(rows: DataFrame, inputs: list[str], outputs: list[str], reg: float = REG) -> DataFrame:
    """Scores of every run under one component of all other runs, without a fit of its own.

    One component takes every row whole in every round, so a model is the
    moments of all runs less those of its own: a pass for the runs' moments,
    one over a row a run for their total, one that scores.
    """
    columns = list(dict.fromkeys([*inputs, *outputs]))
    d = len(columns)
    a, b = [columns.index(c) for c in inputs], [columns.index(c) for c in outputs]
    sums = settle(_run_moments(rows, columns), "run-moments", few=True)
    weighted = lambda c: F.sum(F.col("_n") * c)
    first = sums.agg(F.count("*"), F.sum("_n"), *[weighted(F.get("_mean", F.lit(i))) / F.sum("_n") for i in range(d)]).first()
    if first[0] < 2:
        raise ValueError("at least two nominal runs are needed")
    n, mean = first[1], np.array(first[2:], float)
    off = [F.get("_mean", F.lit(i)) - float(m) for i, m in enumerate(mean)]
    i, j = np.triu_indices(d)
    square = sums.agg(*[weighted(F.get("_cov", F.lit(k)) + off[int(x)] * off[int(y)]) for k, (x, y) in enumerate(zip(i, j))]).first()
    square = _full(np.array([list(square)], float), d)[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own, which = np.unique(part["run_id"].to_numpy(), return_index=True)
            at = np.searchsorted(own, part["run_id"].to_numpy())
            held = part.iloc[which]
            count, means, cov = held["_n"].to_numpy(dtype=float), np.stack(held["_mean"]).astype(float), _full(np.stack(held["_cov"]).astype(float), d)
            # moments about the mean of all rows, less the run's own, moved to the mean of the rest
            left, away = n - count, means - mean
            shift = mean - (count / left)[:, None] * away
            moved = shift - mean
            rest = square - count[:, None, None] * (cov + away[:, :, None] * away[:, None, :]) - left[:, None, None] * moved[:, :, None] * moved[:, None, :]
            rest /= left[:, None, None]
            scale = np.sqrt(np.maximum(rest[:, range(d), range(d)], 0))
            scale[scale == 0] = 1.0
            rest = rest / scale[:, :, None] / scale[:, None, :] + np.eye(d) * reg
            known = np.linalg.pinv(rest[:, a][:, :, a] + np.eye(len(a)) * reg)
            gain = rest[:, b][:, :, a] @ known
            told = rest[:, b][:, :, b] - gain @ rest[:, a][:, :, b]
            told = np.linalg.pinv(0.5 * (told + told.transpose(0, 2, 1)) + 2 * np.eye(len(b)) * reg)
            x = (part[columns].to_numpy(dtype=float) - shift[at]) / scale[at]
            apart = x[:, b] - np.einsum("nij,nj->ni", gain[at], x[:, a])
            distance = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", apart, told[at], apart), 0))
            yield part.drop(columns=["_n", "_mean", "_cov"]).assign(mahalanobis=distance, component=np.zeros(len(part), "int32"), held_out_run=part["run_id"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    joined = rows.join(sums, "run_id").select(*rows.columns, "_n", "_mean", "_cov")
    return joined.mapInPandas(run, f"{schema}, mahalanobis double, component int, held_out_run {kinds['run_id']}")


class _LeftOut:
    """Mixtures of all rows but some of their own, from sums over all rows: own rows of one after the other, in common scales."""

    def __init__(self, x: np.ndarray, first: np.ndarray, base: _Job, begun: np.ndarray, reg: float, weight: float = 1.0):
        d, (i, j) = x.shape[1], np.triu_indices(x.shape[1])
        self.terms, self.first, self.reg, self.weight = _terms(x), first, reg, weight
        self.at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        sums = self._less_own(begun[None], base.begun(x, len(begun)).T)
        left = sums.sum(axis=1)
        mean = left[:, 1 : 1 + d] / left[:, :1]
        variance = left[:, 1 + d :][:, i == j] / left[:, :1] - mean**2
        self.usable = (variance > LEAST_VARIANCE).all(axis=1)
        deviation = np.sqrt(np.where(variance > LEAST_VARIANCE, variance, 1.0))
        self.rows, self.moved = left[:, 0], (1 / deviation, -mean / deviation)
        self.shift, self.scale = base.shift + base.scale * mean, base.scale * deviation
        self.likelihood, self.gain = np.full(len(first), -np.inf), np.full(len(first), np.inf)
        self.model = self._made(sums)

    def _less_own(self, sums: np.ndarray, share: np.ndarray) -> np.ndarray:
        return sums - np.stack([np.add.reduceat(self.weight * s[:, None] * self.terms, self.first) for s in share], axis=1)

    def _made(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _from_sums(_own_scales(sums, *self.moved), self.shift.shape[1], self.reg)

    def forms(self) -> np.ndarray:
        return np.stack(_forms(*self.model, *self.moved))

    def step(self, forms: np.ndarray, sums: np.ndarray, likelihood: np.ndarray, going: np.ndarray) -> None:
        """A round: those still going become what the sums over all rows at their forms, less their own rows', make of them."""
        share, level = shares(np.stack([(self.terms * form.T[self.at]).sum(axis=1) for form in forms]))
        now = (likelihood - np.add.reduceat(self.weight * level, self.first)) / self.rows
        self.gain, self.likelihood = np.abs(now - self.likelihood), now
        for kept, new in zip(self.model, self._made(self._less_own(sums.transpose(2, 0, 1), share))):
            kept[going] = new[going]


def _centres(rows: DataFrame, columns: list[str], series: Series, base: _Job, own: _LeftOut, greatest: np.ndarray, tolerance: float) -> Iterator[tuple[list[Centre], bool]]:
    """A pass a round: what the rows tell of mixtures near some, which move on each time, and whether all of these gained too little."""
    while True:
        forms = own.forms()

        def run(parts: Iterator[pd.DataFrame], forms=forms) -> Iterator[pd.DataFrame]:
            total = sum(series.sums((part.to_numpy(dtype=float) - base.shift) / base.scale, forms) for part in parts)
            if np.ndim(total):
                total = total.ravel()
                groups = range(0, len(total), 4096)
                yield pd.DataFrame({"first": groups, "sums": [total[g : g + 4096].tobytes() for g in groups]})

        added = rows.select(*columns).mapInPandas(run, "first int, sums binary").groupBy("first").applyInArrow(_added, "first int, sums binary")
        total = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(added.collect(), key=lambda r: r["first"])])  # the sums of some centres
        found = [series.centre(sums, forms[:, :, m], greatest) for m, sums in enumerate(total.reshape(forms.shape[2], -1))]
        sums, likelihood, _ = (np.concatenate(x, axis=-1) for x in zip(*(series.near([c], forms[:, :, m : m + 1]) for m, c in enumerate(found))))
        own.step(forms, sums, likelihood, np.ones(len(own.rows), bool))
        yield found, bool((own.gain < tolerance).all())


def _near_centres(rows: DataFrame, sums: DataFrame, inputs: list[str], outputs: list[str], series: Series, components: int = 3, reg: float = REG, rounds: int = 60, tolerance: float = 1e-3, **_) -> DataFrame:
    """Scores of the runs whose mixtures stay so near a centre's that their sums follow from the sums there, and from the run's own rows.

    The first centre is the mixture of all rows; as long as many runs are too
    far from it, some of these are the next centres.  A round of the centres is
    a pass; then a task takes whole runs through all rounds: the sums over all
    rows at a run's mixture (``nearby``) less those of its own rows make its next
    mixture, as a fit over the other rows would.  A run is left to that fit when
    the sums may be off by more than ``OFF`` a row, or when it has more rows than
    a task should hold.
    """
    spark, columns = rows.sparkSession, list(dict.fromkeys([*inputs, *outputs]))
    d, (i, j) = len(columns), np.triu_indices(len(columns))
    (n, shift, scale), parts = _scales(sums, columns, [None])[None], _parts(rows, columns[0], components)
    scale[scale == 0] = 1.0
    base = _Job(None, n, shift, scale, (parts - shift[0]) / scale[0])
    begun = _moments(rows, columns, [base], components)[0][0]
    begun = np.concatenate([begun[:, : 1 + d], begun[:, 1 + d :].reshape(-1, d, d)[:, i, j]], axis=1)
    extent = rows.agg(*[F.max(F.abs((F.col(c) - float(m)) / float(s))) for c, m, s in zip(columns, shift, scale)]).first()
    greatest = _terms(np.array([list(extent)], float))[0]

    def left_out(part: pd.DataFrame) -> _LeftOut:
        ids = part["run_id"].to_numpy()
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return _LeftOut((part[columns].to_numpy(dtype=float) - shift) / scale, first, base, begun, reg)

    def fitted(steps: list[list[Centre]], last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("run_id", kind="stable")
            own = left_out(part)
            state = np.where(own.usable, LATER, FAR)
            for centres in steps:
                forms = own.forms()
                found, likelihood, off = series.near(centres, forms)
                state[(state == LATER) & ~(off <= OFF * own.rows)] = FAR
                own.step(forms, found, likelihood, state == LATER)
                state[(state == LATER) & (own.gain < tolerance)] = SETTLED
                if not (state == LATER).any():
                    break
            if last:
                state[state == LATER] = STOPPED
            raw, state_of = part[columns].to_numpy(dtype=float), state[own.at]
            distance, component = np.zeros(len(part)), np.zeros(len(part), "int32")
            for m, a, b in zip(range(len(state)), own.first, np.append(own.first[1:], len(part))):
                if state[m] <= STOPPED:
                    distance[a:b], component[a:b] = Mixture(inputs, outputs, *(x[m] for x in own.model), own.shift[m], own.scale[m], reg).score(raw[a:b])
            keep = state_of <= STOPPED
            keep[own.first] = True  # a row of each run that is not done
            return part.assign(mahalanobis=distance, component=component, held_out_run=part["run_id"], _state=state_of.astype("int32"))[keep][[*kinds]]

        return run

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"mahalanobis": "double", "component": "int", "held_out_run": rows.schema["run_id"].dataType.simpleString(), "_state": "int"}
    schema, groups = ", ".join(f"`{c}` {t}" for c, t in kinds.items()), max(spark.sparkContext.defaultParallelism, -(-n // GROUP))
    group = F.pmod(F.xxhash64("run_id"), F.lit(groups)).cast("int")
    own = _LeftOut(np.zeros((1, d)), np.zeros(1, int), base, begun, reg, weight=0.0)
    asked, found, late = sums.where(F.col("_n") <= LONG).select("run_id", "_n"), [], 0
    while True:
        centres, steps, going = _centres(rows, columns, series, base, own, greatest, tolerance), [], asked
        while True:
            # as many rounds as the centres take until they gain too little, and again for the runs that go on
            while len(steps) < rounds - 1:
                step, little = next(centres)
                steps.append(step)
                if little:
                    break
            last = len(steps) >= rounds - 1
            whole = rows.join(going.select("run_id"), "run_id", "left_semi").withColumn("_group", group).repartition(groups, "_group")
            found.append(settle(whole.groupBy("_group").applyInPandas(fitted(steps, last), schema), "held-out-near"))
            runs = {r["_state"]: r["n"] for r in found[-1].groupBy("_state").agg(F.count_distinct("run_id").alias("n")).collect()}
            late += runs.get(STOPPED, 0)
            if not runs.get(LATER):
                break
            going = found[-1].where(F.col("_state") == LATER).select("run_id").distinct()
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        every = every.where(F.col("_state") <= STOPPED).drop("_state")
        before, asked = asked.count(), settle(asked.join(every.select("run_id").distinct(), "run_id", "left_anti"), "held-out-far", few=True)
        far = asked.count()
        if far <= FEW or far * n <= FEW_PAIRS or (len(own.rows) > 1 and 4 * far > 3 * before):
            break
        chosen = [r["run_id"] for r in asked.where(F.col("_n") <= GROUP // CENTRES).orderBy(F.xxhash64("run_id"), "run_id").limit(CENTRES).collect()]  # the next centres
        if not chosen:
            break
        own = left_out(rows.where(F.col("run_id").isin(chosen)).select("run_id", *columns).toPandas().sort_values("run_id", kind="stable"))  # bounded: their rows
    if late and tolerance > 0:
        warnings.warn(f"{late} of {sums.count()} mixtures still gained after {rounds} rounds", stacklevel=3)
    return every


def leave_one_out(rows: DataFrame, inputs: list[str], outputs: list[str], models: int = MODELS, limits: bool = True, **options) -> DataFrame:
    """Scores of every run under a model of all other runs (column held_out_run).

    Without ``limits`` there are no component_threshold, epsilon and anomaly;
    one component needs no fit (``_one_component``), and of many runs those
    near others need no fit over the rows of their own (``_near_centres``).
    The others are fitted tile by tile of about ``models`` runs.
    """
    columns = list(dict.fromkeys([*inputs, *outputs]))
    need(rows, "run_id", *columns)
    if not limits and options.get("components", 3) == 1:
        return _one_component(rows, inputs, outputs, options.get("reg", REG))
    spark = rows.sparkSession
    # every round goes through the rows with all models of a tile: they are dealt to all slots, however few they are
    rows = settle(rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "held-out-rows")
    sums = settle(run_sums(rows, columns), "run-sums", few=True)
    runs, near, of_runs = sums.count(), None, rows
    if runs < 2:
        raise ValueError("at least two nominal runs are needed")
    order = order_of(len(columns), options.get("components", 3))
    if not limits and order and options.get("start", "parts") == "parts" and runs > FEW and runs * sums.agg(F.sum("_n")).first()[0] > FEW_PAIRS:
        near = _near_centres(rows, sums, inputs, outputs, Series(len(columns), options.get("components", 3), order), **options)
        left = settle(sums.join(near.select("run_id").distinct(), "run_id", "left_anti").select("run_id"), "held-out-left", few=True)
        runs = left.count()
        if not runs:
            return near
        of_runs = rows.join(left, "run_id", "left_semi").select(*rows.columns)
    tiles, path, schema = -(-runs // models), fresh_path(spark, "held-out-scores"), None
    of_tile = lambda t: F.pmod(F.xxhash64("run_id"), F.lit(tiles)) == t
    for t in range(tiles):
        held = [r["run_id"] for r in (sums if near is None else left).where(of_tile(t)).select("run_id").orderBy("run_id").collect()]  # a tile's runs
        if not held:
            continue
        found = fit(rows, inputs, outputs, hold_out=held, sums=sums, limits=limits, **options)

        def models_of(part: pd.DataFrame, found=found):
            return [(at, found[run]) for run, at in part.groupby("run_id").indices.items()]

        scored = _scored(of_runs.where(of_tile(t)), models_of, columns, limits).withColumn("held_out_run", F.col("run_id"))
        schema = scored.schema
        scored.write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    return found if near is None else near.unionByName(found)


def single_distance(rows: DataFrame, x: str, y: str, reg: float = REG) -> DataFrame:
    """One component, one input, one output: the same in closed form, in built-in functions."""
    stats = rows.agg(F.avg(x).alias("_mx"), F.stddev_pop(x).alias("_sx"), F.avg(y).alias("_my"), F.stddev_pop(y).alias("_sy"), F.covar_pop(x, y).alias("_cxy")).withColumn("_one", F.lit(1))
    s = rows.withColumn("_one", F.lit(1)).join(F.broadcast(stats), "_one")
    a, b = (F.col(x) - F.col("_mx")) / F.col("_sx"), (F.col(y) - F.col("_my")) / F.col("_sy")
    both = F.col("_cxy") / (F.col("_sx") * F.col("_sy"))
    rest = 1 + reg - both * both / (1 + 2 * reg) + reg
    off = b - both / (1 + 2 * reg) * a
    return s.withColumn("mahalanobis", F.sqrt(off * off / (rest + reg))).drop("_one", "_mx", "_sx", "_my", "_sy", "_cxy")
