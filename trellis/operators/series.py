"""Time series on meshes: tables (t, idx, value); every operator keys on t, so slices are independent and one query does all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window(series: DataFrame, first: int = 0, last: int | None = None, step: int = 1) -> DataFrame:
    """Slices first, first + step, ... up to last, renumbered from 0."""
    kept = series.filter((F.col("t") >= first) & ((F.col("t") - first) % step == 0))
    if last is not None:
        kept = kept.filter(F.col("t") <= last)
    return kept.withColumn("t", ((F.col("t") - first) / step).cast("int"))


def extend(series: DataFrame, steps: int, hold: bool = True) -> DataFrame:
    """Slices up to ``steps``: the last one goes on, or zeros."""
    last = series.agg(F.max("t").alias("last"))
    tail = series.join(F.broadcast(last), F.col("t") == F.col("last")).select(F.explode(F.sequence(F.col("last") + 1, F.lit(steps - 1))).alias("t") if steps > 0 else "t", "idx", "value", "last")
    tail = tail.filter((F.col("t") > F.col("last")) & (F.col("t") < steps)).drop("last")
    tail = tail if hold else tail.withColumn("value", F.lit(0.0))
    return series.filter(F.col("t") < steps).unionByName(tail.select("t", "idx", "value"))


def hold_from(series: DataFrame, k: int) -> DataFrame:
    """From step k on the slice k - 1."""
    times = series.select("t").distinct().withColumn("src", F.least("t", F.lit(k - 1)))
    return times.join(series.withColumnRenamed("t", "src"), "src").select("t", "idx", "value")


def periodic(series: DataFrame, periods: int, initial: int = 0) -> DataFrame:
    """Slices 0 .. initial once, then the rest, of T - initial - 1 slices, ``periods`` times over: initial + periods (T - initial - 1) + 1 in all."""
    total = series.agg((F.max("t") + 1).alias("T")).first()["T"]
    length = total - initial - 1
    spark = series.sparkSession
    times = spark.range(initial + periods * length + 1).select(F.col("id").cast("int").alias("t"))
    src = F.when(F.col("t") <= initial, F.col("t")).otherwise(initial + 1 + F.pmod(F.col("t") - initial - 1, F.lit(max(length, 1))))
    return times.withColumn("src", src.cast("int")).join(series.withColumnRenamed("t", "src"), "src").select("t", "idx", "value")


def displacement(series: DataFrame, base: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(t, nid, ux, uy, uz): x * scale - base; the base is the nodes of a mesh, or the first slice. ``series``: (t, nid, x, y, z)."""
    base = series.filter("t = 0").select("nid", *((F.col(c) * scale).alias(c) for c in "xyz")) if base is None else base
    base = base.select("nid", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    return series.join(base, "nid").select("t", "nid", *((F.col(c) * scale - F.col(f"b{c}")).alias(f"u{c}") for c in "xyz"))


def positions(displacements: DataFrame, base: DataFrame) -> DataFrame:
    """The inverse: (t, nid, x, y, z) = base + u."""
    base = base.select("nid", *(F.col(c).alias(f"b{c}") for c in "xyz"))
    return displacements.join(base, "nid").select("t", "nid", *((F.col(f"u{c}") + F.col(f"b{c}")).alias(c) for c in "xyz"))


def collect(ids: DataFrame, attributes: dict[str, DataFrame]) -> DataFrame:
    """(t, idx, <one column for each attribute>) of a mesh's nodes or elements (idx). Series of one step, and tables without t, hold for every step;
    the steps of the others must be the same in number."""
    timed, static = {}, {}
    for name, df in attributes.items():
        if "t" in df.columns and df.select("t").distinct().limit(2).count() > 1:
            timed[name] = df
        else:
            static[name] = df
    steps = {df.agg(F.max("t") + 1).first()[0] for df in timed.values()}
    if len(steps) > 1:
        raise ValueError(f"different numbers of steps: {sorted(steps)}")
    spark = ids.sparkSession
    out = ids.select("idx").crossJoin(F.broadcast(spark.range(steps.pop() if steps else 1).select(F.col("id").cast("int").alias("t"))))
    for name, df in timed.items():
        out = out.join(df.select("t", "idx", F.col("value").alias(name)), ["t", "idx"], "left")
    for name, df in static.items():
        out = out.join(df.select("idx", F.col("value").alias(name)), "idx", "left")
    return out.select("t", "idx", *attributes)


def spatio_temporal(space: DataFrame, trace: DataFrame, amplitude: float = 1.0) -> DataFrame:
    """(t, idx, value): spatial data over its largest absolute value, times a time trace (t, value), times an amplitude."""
    top = space.agg(F.max(F.abs("value")).alias("top"))
    unit = space.crossJoin(F.broadcast(top)).select("idx", (F.when(F.col("top") > 0, F.col("value") / F.col("top")).otherwise(0.0)).alias("s"))
    return unit.crossJoin(F.broadcast(trace.select("t", F.col("value").alias("w")))).select("t", "idx", (F.col("s") * F.col("w") * amplitude).alias("value"))


def reaction_force(stress: DataFrame, faces: DataFrame) -> DataFrame:
    """(t, value): sum over faces (eid, nx, ny, nz, area) of |sigma n| * area, with stress (t, eid, s array<double>[9]) by rows."""
    rows = stress.join(faces, "eid")
    n = [F.col(f"n{c}") for c in "xyz"]
    traction = [sum((F.get("s", F.lit(3 * i + j)) * n[j] for j in (1, 2)), F.get("s", F.lit(3 * i)) * n[0]) for i in range(3)]
    size = F.sqrt(traction[0] * traction[0] + traction[1] * traction[1] + traction[2] * traction[2])
    return rows.groupBy("t").agg(F.sum(size * F.col("area")).alias("value"))


def deactivate(series: DataFrame, inactive: DataFrame) -> DataFrame:
    """Zero where the node is in the inactive region (idx)."""
    return series.join(inactive.select("idx").distinct().withColumn("_off", F.lit(True)), "idx", "left").select("t", "idx", F.when(F.col("_off"), 0.0).otherwise(F.col("value")).alias("value"))


def without_rigid_motion(series: DataFrame) -> DataFrame:
    """Displacements (t, nid, ux, uy, uz) without each step's mean."""
    means = series.groupBy("t").agg(*(F.avg(f"u{c}").alias(f"m{c}") for c in "xyz"))
    return series.join(means, "t").select("t", "nid", *((F.col(f"u{c}") - F.col(f"m{c}")).alias(f"u{c}") for c in "xyz"))


def combine(base_ids: DataFrame, parts: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Series of submeshes, each with its mapping, scattered into the base mesh (idx); later parts win, 0 elsewhere."""
    rows = None
    for order, (series, mapping) in enumerate(parts):
        placed = series.withColumnRenamed("idx", "sub_idx").join(mapping, "sub_idx").select("t", F.col("mesh_idx").alias("idx"), "value", F.lit(order).alias("o"))
        rows = placed if rows is None else rows.unionByName(placed)
    best = rows.groupBy("t", "idx").agg(F.max_by("value", "o").alias("value"))
    every = base_ids.select("idx").crossJoin(F.broadcast(rows.select("t").distinct()))
    return every.join(best, ["t", "idx"], "left").select("t", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))


def refine_time(series: DataFrame, factor: int, low: float | None = None, high: float | None = None, derivative: bool = False) -> DataFrame:
    """Cubic splines of zero slope at both ends through each index's steps, at ``factor`` points for each step, clamped to [low, high], or
    their derivative. An index whose series starts at step t0 starts at t0 * factor.

    One group is one index's series; groups are independent, and a series is solved in time and memory of its length."""
    import numpy as np
    import pandas as pd

    def bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Second derivatives at the knots, by elimination in the three diagonals."""
        h = np.diff(x)
        slope = np.concatenate(([0.0], np.diff(y) / h, [0.0]))
        diagonal = 2 * (np.concatenate(([0.0], h)) + np.concatenate((h, [0.0])))
        right = 6 * np.diff(slope)
        for i in range(1, len(x)):
            w = h[i - 1] / diagonal[i - 1]
            diagonal[i] -= w * h[i - 1]
            right[i] -= w * right[i - 1]
        out = right / diagonal
        for i in range(len(x) - 2, -1, -1):
            out[i] -= h[i] * out[i + 1] / diagonal[i]
        return out

    def spline(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x, y = pdf.t.to_numpy(dtype=float), pdf.value.to_numpy(dtype=float)
        n = len(x)
        at = x[0] + np.arange((int(round(x[-1] - x[0]))) * factor + 1) / factor
        if n == 1:
            out = np.zeros(1) if derivative else y
        else:
            h, m = np.diff(x), bends(x, y)
            i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
            u, v = x[i + 1] - at, at - x[i]
            if derivative:
                out = (m[i + 1] * v**2 - m[i] * u**2) / (2 * h[i]) + (y[i + 1] - y[i]) / h[i] - h[i] * (m[i + 1] - m[i]) / 6
            else:
                out = (m[i] * u**3 + m[i + 1] * v**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * u + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * v
        if low is not None or high is not None:
            out = np.clip(out, low, high)
        return pd.DataFrame({"t": int(round(x[0])) * factor + np.arange(len(at), dtype="int32"), "idx": pdf.idx.iloc[0], "value": out})

    return series.groupBy("idx").applyInPandas(spline, "t int, idx long, value double")


def steps_equal(*tables: DataFrame) -> None:
    """Raise unless all series have the same number of steps."""
    found = {df.agg(F.max("t") + 1).first()[0] for df in tables}
    if len(found) > 1:
        raise ValueError(f"different numbers of steps: {sorted(found, key=str)}")


def latest(series: DataFrame) -> DataFrame:
    """Each index's value at its last step."""
    return series.withColumn("_r", F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("t")))).filter("_r = 1").drop("_r")
