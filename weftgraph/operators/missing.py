"""Filling missing values from similar records (problem 2).

Expectation-maximisation for a mixture over mixed data: component k has a share pi_k, a
categorical distribution theta_k over the types and a Gaussian (mu_k, diagonal var_k) over
the vector, of a scale that is the record's own (so that few records far out do not decide a
mean: the marginal is a Student distribution).  Records with a missing part take part in the
fit with the part they have.

* Fit: until the likelihood rests, every iteration is one pass in which each task turns its rows into K rows of
  sufficient statistics; those are summed on the cluster and K x (1 + types + 2 x dims)
  numbers reach the driver, whatever the size of the data.
* Groups: records of one session (or, without a session, of one span of time) share a
  mixing vector, a distribution of types and a shift.  All are sums over the group, gathered
  per task first, so a group with a third of all rows sends one row a task.
* Fill: a missing type becomes the mode of its conditional distribution, a missing vector
  its conditional expectation, given the part that is there, the group's mixing, types and
  shift.  How much a vector says about the type beyond its group is measured on known types.
  A mask column marks each filled value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.core.session import collect_bounded, cut


def type_key(name: Column) -> Column:
    """Types compare without letter case and without blanks and tabs around them."""
    return F.lower(F.btrim(name, F.lit(" \t")))


def vector_missing(vec: Column, n_dims: int) -> Column:
    """Null, fewer than n_dims components, a component that is null or not finite, or only zeros."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vec.isNull() | (F.size(vec) < n_dims) | bad | F.forall(vec, lambda v: v == 0), F.lit(True))


@dataclass
class Mixture:
    share: np.ndarray  # K
    theta: np.ndarray  # K x types
    mean: np.ndarray  # K x dims
    var: np.ndarray  # K x dims
    shift_var: np.ndarray  # dims: variance of the groups' shifts
    tails: float  # degrees of freedom of the scales
    evidence: float = 1.0  # power of what a vector says about the type beyond its group

    def expect(self, code: np.ndarray, x: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(responsibilities, weights of the vectors by their scales, log likelihoods); rows x K, the last by row.

        code -1: no type; a row of x that is NaN: no vector.  Constants of the likelihood are left out.
        """
        out = np.log(self.share)[None, :] + np.zeros((len(code), 1)) if prior is None else np.log(prior)
        typed = code >= 0
        out[typed] += np.log(self.theta).T[code[typed]]
        weight, dims = np.zeros(out.shape), x.shape[1]
        with_x = ~np.isnan(x[:, 0])
        if with_x.any():
            v = x[with_x]
            inv = 1.0 / self.var
            quad = np.maximum((v**2) @ inv.T - 2 * v @ (self.mean * inv).T + (self.mean**2 * inv).sum(1)[None, :], 0)
            out[with_x] -= 0.5 * ((self.tails + dims) * np.log1p(quad / self.tails) + np.log(self.var).sum(1)[None, :])
            weight[with_x] = (self.tails + dims) / (self.tails + quad)
        top = out.max(1, keepdims=True)
        r = np.exp(out - top)
        total = r.sum(1, keepdims=True)
        return r / total, weight, (np.log(total) + top)[:, 0]


def _matrix(col: pa.ListArray, n_dims: int) -> np.ndarray:
    """Rows of n_dims values; NaN for what is null or of another length."""
    x = np.full((len(col), n_dims), np.nan)
    size = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = size == n_dims
    x[good] = col.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_dims)
    return x


def _rows(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _statistics(model: Mixture, n_types: int, n_dims: int):
    k = len(model.share)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, t, loglik = np.zeros(k), np.zeros((k, n_types)), np.zeros(k)
        w, u, s, q = np.zeros(k), np.zeros(k), np.zeros((k, n_dims)), np.zeros((k, n_dims))
        for part in parts:
            code, x = part.column(0).to_numpy(), _matrix(part.column(1), n_dims)
            r, weight, each = model.expect(code, x)
            loglik[0] += each.sum()
            n += r.sum(0)
            for c in range(n_types):
                t[:, c] += r[code == c].sum(0)
            have = ~np.isnan(x[:, 0])
            r, x, ru = r[have], x[have], (r * weight)[have]
            w += r.sum(0)
            u += ru.sum(0)
            s += ru.T @ x
            q += ru.T @ (x**2)
        stats = np.concatenate([n[:, None], t, w[:, None], u[:, None], loglik[:, None], s, q], axis=1)
        width = stats.shape[1]
        at = np.arange(k * width)
        yield pa.RecordBatch.from_pydict({"k": (at // width).astype(np.int32), "p": (at % width).astype(np.int32), "v": stats.ravel()})

    return run


def _summed(rows: DataFrame, model: Mixture, n_types: int, n_dims: int) -> np.ndarray:
    k, width = len(model.share), 4 + n_types + 2 * n_dims
    partial = rows.select("code", "x").mapInArrow(_statistics(model, n_types, n_dims), "k int, p int, v double")
    out = np.zeros((k, width))
    for r in collect_bounded(partial.groupBy("k", "p").agg(F.sum("v").alias("v")), k * width, "sufficient statistics"):
        out[r["k"], r["p"]] = r["v"]
    return out


def fit_mixture(
    rows: DataFrame, n_types: int, n_dims: int, components: int = 12, iterations: int = 12, rest: float = 0.02, tails: float = 8.0, floor: float = 1e-3, seed: int = 7
) -> Mixture:
    """Fit on all of `rows` (code INT or -1, x ARRAY<DOUBLE> or null).

    The start is a fixed spread around the overall mean; one statistics pass gives it.  Updates
    end when one gains less than `rest` per record in log likelihood, or after `iterations`.  With
    no vectors at all the Gaussians stay at (0, 1); with no rows the model is uniform.
    """
    rng = np.random.default_rng(seed)
    one = Mixture(np.ones(1), np.full((1, n_types), 1 / n_types), np.zeros((1, n_dims)), np.ones((1, n_dims)), np.zeros(n_dims), 1e12)  # all weights are 1
    vectors = 4 + n_types
    first = _summed(rows, one, n_types, n_dims)[0]
    w = max(first[1 + n_types], 1.0)
    mean = first[vectors : vectors + n_dims] / w
    var = np.maximum(first[vectors + n_dims :] / w - mean**2, floor) if first[1 + n_types] else np.ones(n_dims)
    model = Mixture(
        np.full(components, 1 / components),
        rng.dirichlet(np.full(n_types, 1.0), components) * 0.5 + 0.5 / n_types,
        mean + rng.normal(0, 0.7, (components, n_dims)) * np.sqrt(var),
        np.tile(var, (components, 1)),
        np.zeros(n_dims),
        tails,
    )
    before = -np.inf
    for _ in range(iterations):
        st = _summed(rows, model, n_types, n_dims)
        n, t, w, u, loglik = st[:, 0], st[:, 1 : 1 + n_types], st[:, 1 + n_types], st[:, 2 + n_types], st[:, 3 + n_types].sum()
        s, q = st[:, vectors : vectors + n_dims], st[:, vectors + n_dims :]
        theta = (t + 1.0 / n_types) / (t.sum(1, keepdims=True) + 1.0)
        share = (n + 1.0) / (n.sum() + components)
        # One pseudo-record of the overall distribution keeps empty components alive.
        mu = (s + mean) / (u + 1)[:, None]
        sq = q + var + mean**2 - 2 * mu * (s + mean) + mu**2 * (u + 1)[:, None]
        model = Mixture(share, theta, mu, np.maximum(sq / (w + 1)[:, None], floor), np.zeros(n_dims), tails)
        if loglik - before < rest * max(1.0, n.sum()):
            break
        before = loglik
    return model


def _group_partials(model: Mixture, n_dims: int, most: int = 4096):
    """One row a group and task: mixing counts, sum of precision-weighted residuals, precision, type counts."""
    n_types = model.theta.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"grp": list(held), "stats": list(held.values())})
            held.clear()
            return out

        inv = 1.0 / model.var
        for part in parts:
            code, x = _rows(part, "code"), _matrix(part.column(part.schema.get_field_index("x")), n_dims)
            r, weight, _ = model.expect(code, x)
            ru = r * weight
            prec = ru @ inv
            resid = np.nan_to_num(x) * prec - ru @ (model.mean * inv)
            kinds = np.zeros((len(code), n_types))
            kinds[np.flatnonzero(code >= 0), code[code >= 0]] = 1.0
            stats = np.concatenate([r, resid, prec, kinds], axis=1)
            keys, at = np.unique(_rows(part, "grp").astype(str), return_inverse=True)
            total = np.zeros((len(keys), stats.shape[1]))
            np.add.at(total, at, stats)
            for key, row in zip(keys, total):
                held[key] = held[key] + row if key in held else row
            if len(held) >= most:
                yield flush()
        if held:
            yield flush()

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "stats": [np.sum(np.stack(pdf["stats"].to_list()), axis=0)]})


def _shift_variance(groups: DataFrame, k: int, n_dims: int) -> np.ndarray:
    """Moments: E[(resid / prec)^2 - 1 / prec] over the groups, at least 0."""
    g = groups.select(
        F.slice("stats", k + 1, n_dims).alias("a"), F.slice("stats", k + n_dims + 1, n_dims).alias("b")
    ).select(F.posexplode(F.arrays_zip("a", "b")).alias("p", "z")).filter("z.b > 0")
    m = F.col("z.a") / F.col("z.b")
    rows = collect_bounded(g.groupBy("p").agg(F.avg(m * m - 1 / F.col("z.b")).alias("v")), n_dims, "shift variances")
    out = np.zeros(n_dims)
    for r in rows:
        out[r["p"]] = max(0.0, r["v"])
    return out


POWERS = (0.0, 0.25, 0.5, 1.0)


def _evidence(model: Mixture, n_dims: int, strength: float):
    """(code, x, kinds of the group) -> (p, v): log likelihood of known types, each left out of its group, for each of POWERS."""
    overall = model.share @ model.theta

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(POWERS))
        for part in parts:
            code, x = part.column(0).to_numpy(), _matrix(part.column(1), n_dims)
            at = np.arange(len(code)), code
            others = _matrix(part.column(2), len(overall))
            others[at] -= 1
            own = np.maximum(others, 0) + strength * overall
            said = (model.expect(np.full(len(code), -1), x)[0] @ model.theta) / overall
            for i, power in enumerate(POWERS):
                p = own * said**power
                total[i] += np.log(p[at] / p.sum(1)).sum()
        yield pa.RecordBatch.from_pydict({"p": np.arange(len(POWERS), dtype=np.int32), "v": total})

    return run


def _filler(model: Mixture, types: list[str], n_dims: int, strength: float):
    k = len(model.share)
    overall = model.share @ model.theta

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            code, x = _rows(part, "code"), _matrix(part.column(part.schema.get_field_index("x")), n_dims)
            stats = np.nan_to_num(_matrix(part.column(part.schema.get_field_index("stats")), k + 2 * n_dims + len(types)))
            counts, a, b, kinds = np.split(stats, [k, k + n_dims, k + 2 * n_dims], axis=1)
            prior = (counts + strength * model.share) / (counts.sum(1, keepdims=True) + strength)
            shift = a * model.shift_var / (1.0 + b * model.shift_var)
            r = model.expect(code, x, prior)[0]
            # The group's types, shrunk to the overall ones, times what the vector says beyond them.
            own = (kinds + strength * overall) / (kinds.sum(1, keepdims=True) + strength)
            said = (model.expect(code, x)[0] @ model.theta) / overall
            best = (own * said**model.evidence).argmax(1)
            expected = r @ model.mean + shift
            no_vec = _rows(part, "no_vec")
            named = pa.array([types[c] if m else None for c, m in zip(best, code < 0)], pa.string())
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(no_vec * n_dims)]).astype(np.int32)), pa.array(expected[no_vec.astype(bool)].ravel()), mask=pa.array(~no_vec.astype(bool)))
            keep = [n for n in part.schema.names if n not in ("stats", "code", "x")]
            yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(n)) for n in keep], named, vectors], [*keep, "fill_type", "fill_vec"])

    return run


def fill_missing(
    df: DataFrame,
    types: DataFrame,
    id_col: str = "node_id",
    type_col: str = "node_type",
    vec_col: str = "node_embeds",
    group_col: str = "session_id",
    time_col: str = "seen_at",
    n_dims: int = 64,
    components: int = 12,
    iterations: int = 12,
    span_s: int = 21_600,
    strength: float = 2.0,
    max_types: int = 1_000,
) -> DataFrame:
    """(id, group, time, type, vector, <type>_filled, <vector>_filled): a row for each row of `df`.

    Types that are there come out as spelled in `types` (first column `node_type`).  A type is
    missing if it is null or none of `types` regardless of case and of blanks and tabs around
    it; a vector if it is null, has fewer than n_dims components, one that is null or not
    finite, or only zeros (one with more than n_dims is kept and not used in the fit).  Both
    masks are never null.  A row without group falls back to the records of its span of
    `span_s` seconds, one without either to the overall distribution.  Repeated rows are
    filled alike and kept.  Empty input gives no rows; with no observed record at all,
    vectors become zeros and types the first of `types`.  Other columns are left out.

    `strength`: pseudo-records with which the overall mixing shrinks a group's.
    """
    names = sorted({r[0] for r in collect_bounded(types.select("node_type").filter("node_type is not null").distinct(), max_types, "types")})
    if not names:
        raise ValueError("no types given")
    spelled = F.create_map(*[F.lit(y) for i, n in enumerate(names) for y in (n.lower(), i)])
    grp = F.coalesce(
        F.concat(F.lit("g"), F.col(group_col).cast("string")),
        F.concat(F.lit("t"), F.floor(F.unix_timestamp(F.col(time_col).cast("timestamp")) / span_s).cast("string")),
        F.lit("-"),
    )
    vec = F.col(vec_col).cast("array<double>")
    base = df.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp_raw"), F.col(time_col).alias("at"), grp.alias("grp"),
        F.coalesce(F.try_element_at(spelled, type_key(F.col(type_col).cast("string"))), F.lit(-1)).alias("code"),
        vec.alias("vec"), vector_missing(vec, n_dims).alias("no_vec"),
    ).withColumn("x", F.when(~F.col("no_vec") & (F.size("vec") == n_dims), F.col("vec")))
    base = cut(base)
    seen = base.select("grp", "code", "x").filter("code >= 0 or x is not null")
    model = fit_mixture(seen.select("code", "x"), len(names), n_dims, components, iterations)
    groups = cut(
        seen.mapInArrow(_group_partials(model, n_dims), "grp string, stats array<double>")
        .groupBy("grp").applyInPandas(_add_up, "grp string, stats array<double>")
    )
    model.shift_var = _shift_variance(groups, components, n_dims)
    # Vectors weigh on types as far as known types bear it out.
    kinds = groups.select("grp", F.slice("stats", components + 2 * n_dims + 1, len(names)).alias("kinds"))
    told = seen.filter("code >= 0 and x is not null").join(kinds, "grp").select("code", "x", "kinds").mapInArrow(_evidence(model, n_dims, strength), "p int, v double")
    gains = dict(collect_bounded(told.groupBy("p").agg(F.sum("v").alias("v")), len(POWERS), "powers"))
    model.evidence = POWERS[max(gains, key=lambda p: (gains[p], -p))] if gains else 0.0
    lacking = base.filter("code < 0 or no_vec").join(groups, "grp", "left")
    schema = "grp string, id " + dict(base.dtypes)["id"] + ", grp_raw " + dict(base.dtypes)["grp_raw"] + ", at " + dict(base.dtypes)["at"]
    filled = lacking.select("grp", "id", "grp_raw", "at", "vec", "no_vec", "code", F.col("code").alias("c0"), "x", "stats").mapInArrow(
        _filler(model, names, n_dims, strength),
        schema + ", vec array<double>, no_vec boolean, c0 int, fill_type string, fill_vec array<double>",
    )
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.when(F.col("c0") >= 0, F.col("c0") + 1))
    out = [F.col("id").alias(id_col), F.col("grp_raw").alias(group_col), F.col("at").alias(time_col)]
    whole = base.filter("code >= 0 and not no_vec").withColumn("c0", F.col("code"))
    return filled.select(
        *out, F.coalesce("fill_type", named).alias(type_col),
        F.when(F.col("no_vec"), F.col("fill_vec")).otherwise(F.col("vec")).alias(vec_col),
        (F.col("c0") < 0).alias(f"{type_col}_filled"), F.col("no_vec").alias(f"{vec_col}_filled"),
    ).unionByName(whole.select(
        *out, named.alias(type_col), F.col("vec").alias(vec_col),
        F.lit(False).alias(f"{type_col}_filled"), F.lit(False).alias(f"{vec_col}_filled"),
    ))


def filled_fields(filled: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field): each value that a mask of `filled` marks, once."""
    marks = F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in fields])
    return filled.select(id_col, F.explode(marks).alias("field")).filter("field is not null").distinct()
