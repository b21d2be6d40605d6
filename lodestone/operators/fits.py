"""Surrogate models of table rows: one for each group, fitted in parallel, kept as rows, joined to the rows they predict.

A model is fitted to a group's design: its different inputs with their mean response, at most DESIGN of them, those
with the smallest hashes (an exact fit solves a system of that size, so the bound is the method's; it is a parameter).
Rows with a null, NaN or infinite input or response teach nothing. A group whose design is too small for its model, or
whose fit fails, has no state, and its rows no prediction.

Rows to be predicted are dealt into blocks of at most BLOCK rows of a group, and each block meets its group's state
once, so neither a group nor the states are ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.models import CoKriging, Kriging, Radial, Unit, expected_improvement
from lodestone.operators.metric import usable

DESIGN, BLOCK = 80, 4096
STATE = "group string, n int, best double, state map<string,array<double>>"
_PREDICTED = "group string, id long, y double, mean double, sd double, ei double"


def _put(model: Kriging | Radial | CoKriging) -> dict[str, np.ndarray]:
    """What a model needs to predict, as arrays."""
    if isinstance(model, CoKriging):
        parts = {f"{name}.{k}": v for name, m in (("coarse", model.coarse), ("difference", model.difference)) for k, v in _put(m).items()}
        return parts | {"rho": np.array([model.rho])}
    both = {"low": model.unit.low, "span": model.unit.span, "points": model.u.ravel()}
    if isinstance(model, Radial):
        return both | {"weights": model.weights, "eps": np.array([model.eps]), "kind": np.array([KINDS.index(model.kind)], float)}
    s = model.state
    return both | {"theta": s["theta"], "weights": s["weights"], "factor": s["low"].ravel(), "numbers": np.array([s["mu"], s["sigma2"], model.shift, model.scale, model.nugget])}


KINDS = ["cubic", "linear", "thin_plate", "gaussian"]


def _got(state: dict[str, np.ndarray]) -> Kriging | Radial | CoKriging:
    """A model that predicts as the one put away did."""
    if "rho" in state:
        model = CoKriging()
        model.coarse, model.difference = (_got({k.removeprefix(f"{name}."): v for k, v in state.items() if k.startswith(f"{name}.")}) for name in ("coarse", "difference"))
        model.rho = float(state["rho"][0])
        return model
    model = Radial(KINDS[int(state["kind"][0])], eps=float(state["eps"][0])) if "kind" in state else Kriging()
    model.unit = Unit.__new__(Unit)
    model.unit.low, model.unit.span = state["low"], state["span"]
    model.u = state["points"].reshape(-1, len(state["low"]))
    if isinstance(model, Radial):
        model.weights = state["weights"]
        return model
    mu, sigma2, model.shift, model.scale, model.nugget = state["numbers"].tolist()
    n = len(model.u)
    model.state = {"theta": state["theta"], "mu": mu, "sigma2": sigma2, "weights": state["weights"], "low": state["factor"].reshape(n, n)}
    return model


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Inputs, all usable and of one length, as rows."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def designs(rows: DataFrame, limit: int = DESIGN) -> DataFrame:
    """(group, level, x, y): of (group, level, x array<double>, y) the inputs that teach; level tells the fidelity, 0 the finest."""
    good = rows.filter(usable(F.col("x")) & usable(F.array("y")) & F.col("group").isNotNull())
    mean = good.groupBy("group", "level", "x").agg(F.avg("y").alias("y"))
    order = F.row_number().over(Window.partitionBy("group", "level").orderBy(F.xxhash64("x"), "x"))
    return mean.withColumn("k", order).filter(F.col("k") <= limit).drop("k")


def fit(rows: DataFrame, make: Callable, limit: int = DESIGN) -> DataFrame:
    """NUM18, NUM21, NUM26: (group, n, best, state) of rows (group, x, y), or (group, level, x, y) for two fidelities.

    make() gives a model to fit: to (x, y), or for two fidelities to (coarse x, y, fine x, y). best: the least fine
    response of the design.
    """
    two = "level" in rows.columns
    design = designs(rows if two else rows.withColumn("level", F.lit(0)), limit)

    def run(t: pa.Table) -> pa.Table:
        group, level, y = t["group"][0].as_py(), t["level"].to_numpy(), t["y"].to_numpy()
        # In an order that no shuffle changes.
        x = np.array(t["x"].to_pylist(), float)
        order = np.lexsort([*x.T, level])
        x, y, level = x[order], y[order], level[order]
        fine, out = level == 0, []
        try:
            model = make().fit(x[~fine], y[~fine], x[fine], y[fine]) if two else make().fit(x, y)
            out = [{"group": group, "n": int(fine.sum()), "best": float(y[fine].min()), "state": [(k, v.tolist()) for k, v in _put(model).items()]}]
        except (ValueError, np.linalg.LinAlgError):
            pass
        return pa.Table.from_pylist(out, pa.schema([("group", pa.string()), ("n", pa.int32()), ("best", pa.float64()), ("state", pa.map_(pa.string(), pa.list_(pa.float64())))]))

    return design.withColumn("group", F.col("group").cast("string")).groupBy("group").applyInArrow(run, STATE)


def predict(states: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """NUM19, NUM21, NUM22, NUM26: (group, id, y, mean, sd, ei) of rows (group, id, x) whose group has a state and whose x is usable.

    y is the rows' own, null if they have none. Ids need not be unique.
    """
    y = F.col("y").cast("double") if "y" in rows.columns else F.lit(None).cast("double")
    asked = rows.filter(usable(F.col("x"))).select(F.col("group").cast("string").alias("group"), "id", "x", y.alias("y"))
    sizes = asked.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = asked.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).drop("blocks")
    each = states.join(sizes, "group").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def run(t: pa.Table, s: pa.Table) -> pa.Table:
        if not len(t) or not len(s):
            return pa.table({n: pa.array([], k) for n, k in zip(("group", "id", "y", "mean", "sd", "ei"), (pa.string(), pa.int64(), *[pa.float64()] * 4), strict=True)})
        model = _got({k: np.array(v, float) for k, v in s["state"][0].as_py()})
        mean, sd = model.predict(_matrix(t["x"]))
        ei = expected_improvement(mean, sd, s["best"][0].as_py())
        return pa.table({"group": t["group"], "id": t["id"], "y": t["y"], "mean": pa.array(mean), "sd": pa.array(sd), "ei": pa.array(ei)})

    return dealt.groupBy("group", "block").cogroup(each.groupBy("group", "block")).applyInArrow(run, _PREDICTED)


def explained(predicted: DataFrame) -> DataFrame:
    """(group, n, r2): the share of the variance of the rows' y that the predictions explain; null without variance."""
    s = predicted.filter(usable(F.array("y"))).groupBy("group").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("mean"), 2)).alias("left"), (F.var_pop("y") * F.count("*")).alias("all"))
    return s.select("group", "n", F.when(F.col("all") > 1e-12, 1 - F.col("left") / F.col("all")).alias("r2"))


def left_out(rows: DataFrame, make: Callable, limit: int = DESIGN) -> DataFrame:
    """NUM20: (group, n, rmse) over refits of each group's model without each point of its design, side by side; failed refits are left out."""
    design = designs(rows.withColumn("level", F.lit(0)), limit).withColumn("group", F.col("group").cast("string")).select("group", "x", "y")
    # A group's design once for each of its points, which a design's size bounds.
    folds = design.select("group", F.col("x").alias("without")).join(design, "group")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x, y, out = np.array(t["x"].to_pylist(), float), t["y"].to_numpy(), t["without"][0].as_py()
        order = np.lexsort(x.T)
        x, y = x[order], y[order]
        gone = (x == np.array(out, float)).all(1)
        try:
            error = [float(make().fit(x[~gone], y[~gone]).predict(x[gone])[0][0] - y[gone][0]) ** 2]
        except (ValueError, np.linalg.LinAlgError):
            error = [None]
        return pa.table({"group": pa.array([key[0].as_py()]), "e": pa.array(error, pa.float64())})

    return folds.groupBy("group", "without").applyInArrow(run, "group string, e double").groupBy("group").agg(F.count("e").alias("n"), F.sqrt(F.avg("e")).alias("rmse"))
