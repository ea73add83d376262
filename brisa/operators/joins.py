"""Checked equi-joins, nearest points, curve look-ups and snapshot differences."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brisa.constants import EARTH_RADIUS_KM, MAX_CLIMATE_KM
from brisa.functions.numeric import haversine_km
from brisa.operators import ordered
from brisa.operators.cleaning import require_unique

UNIQUE_SIDES = {"one_to_one": "lr", "one_to_many": "l", "many_to_one": "r", "many_to_many": ""}
HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full_outer"}


def safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
              suffixes: tuple[str, str] = ("", "_dir"), validate: str | None = None) -> DataFrame:
    """Equi-join in which null keys meet null keys, with the cardinality checked."""
    on = [on] if isinstance(on, str) else list(on)
    sides = UNIQUE_SIDES[validate or "many_to_many"]
    if "l" in sides:
        require_unique(left, on)
    if "r" in sides:
        require_unique(right, on)
    shared = [c for c in right.columns if c in left.columns and c not in on]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared} | {k: f"__r_{k}" for k in on})
    cond = None
    for k in on:
        term = a[k].eqNullSafe(b[f"__r_{k}"])
        cond = term if cond is None else cond & term
    joined = a.join(b, cond, HOW[how])
    keys = [F.coalesce(F.col(k), F.col(f"__r_{k}")).alias(k) if k in on else F.col(k) for k in a.columns]
    return joined.select(*keys, *[c for c in b.columns if not c.startswith("__r_")])


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows and repeated keys per side, rows with and without a pair,
    rows of an inner join. Built from counts per key, never from the join itself."""
    on = [on] if isinstance(on, str) else list(on)
    a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__a"))
    b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__b"))
    both = ordered.null_safe(a, b.withColumn("__has", F.lit(1)), on, "left")
    lefts = both.agg(
        F.sum("__a").alias("linhas_esquerda"),
        F.sum(F.col("__a") - 1).alias("repetidas_esquerda"),
        F.coalesce(F.sum(F.when(F.col("__b").isNotNull(), F.col("__a"))), F.lit(0)).alias("com_par"),
        F.coalesce(F.sum(F.when(F.col("__b").isNull(), F.col("__a"))), F.lit(0)).alias("sem_par"),
        F.coalesce(F.sum(F.col("__a") * F.col("__b")), F.lit(0)).alias("linhas_internas"))
    rights = b.agg(F.sum("__b").alias("linhas_direita"), F.sum(F.col("__b") - 1).alias("repetidas_direita"))
    return lefts.join(F.broadcast(rights))


# --------------------------------------------------------------- nearest point
BROADCAST_POINTS = 2000
MAX_PER_CELL = 32


def nearest_point(units: DataFrame, points: DataFrame, unit: str, point: str,
                  unit_xy: tuple[str, str] = ("lat", "lon"),
                  point_xy: tuple[str, str] = ("latitude", "longitude"),
                  broadcast_limit: int = BROADCAST_POINTS) -> DataFrame:
    """(unit, point, distancia_km) of the nearest point; ties go to the smaller name.

    A counted, small set of points travels to every task. A larger set is searched
    by equal cells that double in size until the answer is sure.
    """
    places = (points.filter(F.col(point_xy[0]).isNotNull() & F.col(point_xy[1]).isNotNull())
              .groupBy(F.col(point_xy[0]).cast("double").alias("__plat"),
                       F.col(point_xy[1]).cast("double").alias("__plon"))
              .agg(F.min(point).alias(point)))
    known = units.filter(F.col(unit_xy[0]).isNotNull() & F.col(unit_xy[1]).isNotNull())
    spots = known.select(F.col(unit_xy[0]).cast("double").alias("__ulat"),
                         F.col(unit_xy[1]).cast("double").alias("__ulon")).distinct()
    if places.limit(broadcast_limit + 1).count() <= broadcast_limit:
        found = _nearest_by_array(spots, places, point)
    else:
        found = _nearest_by_cells(spots, places, point)
    return known.select(unit, F.col(unit_xy[0]).cast("double").alias("__ulat"),
                        F.col(unit_xy[1]).cast("double").alias("__ulon")).join(
        found, ["__ulat", "__ulon"]).select(unit, point, "distancia_km")


def _nearest_by_array(spots: DataFrame, places: DataFrame, point: str) -> DataFrame:
    """Distances to the few points as one matrix per Arrow batch."""
    rows = sorted((r[point], r["__plat"], r["__plon"]) for r in places.collect())   # counted by the caller
    if not rows:
        return spots.select("__ulat", "__ulon", F.lit(None).cast("string").alias(point),
                            F.lit(None).cast("double").alias("distancia_km")).limit(0)
    names = np.array([r[0] for r in rows], dtype=object)
    lat, lon = np.radians([r[1] for r in rows]), np.radians([r[2] for r in rows])

    @F.pandas_udf("nome string, km double")
    def nearest(a: pd.Series, o: pd.Series) -> pd.DataFrame:
        best, km = np.empty(len(a), dtype=int), np.empty(len(a))
        ua, uo = np.radians(a.to_numpy()), np.radians(o.to_numpy())
        for i in range(0, len(a), 512):
            part = slice(i, i + 512)
            h = (np.sin((lat[None, :] - ua[part, None]) / 2) ** 2
                 + np.cos(ua[part, None]) * np.cos(lat)[None, :] * np.sin((lon[None, :] - uo[part, None]) / 2) ** 2)
            best[part] = h.argmin(1)
            km[part] = 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(np.sqrt(h.min(1)), 1.0))
        return pd.DataFrame({"nome": names[best], "km": km})

    return spots.withColumn("__n", nearest("__ulat", "__ulon")).select(
        "__ulat", "__ulon", F.col("__n.nome").alias(point), F.col("__n.km").alias("distancia_km"))


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    a, o = F.radians(lat), F.radians(lon)
    return df.withColumns({"__x": F.cos(a) * F.cos(o), "__y": F.cos(a) * F.sin(o), "__z": F.sin(a)})


def _cell(size: float) -> list[Column]:
    return [F.floor(F.col(f"__{axis}") / F.lit(size)).cast("long").alias(f"c{axis}") for axis in "xyz"]


def _nearest_by_cells(spots: DataFrame, places: DataFrame, point: str) -> DataFrame:
    """Cells are cubes around the unit sphere. A point within one cube side lies in
    the 27 cubes around the unit, so a nearest distance up to the side is final."""
    left = ordered.cut(_on_sphere(spots, "__ulat", "__ulon"))
    right = ordered.cut(_on_sphere(places, "__plat", "__plon"))
    size = 0.25
    while size > 1e-6:                       # start where no cube is crowded
        crowd = right.groupBy(*_cell(size)).count().agg(F.max("count")).first()[0] or 0
        if crowd <= MAX_PER_CELL:
            break
        size /= 4
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    done = None
    while True:
        near = left.select("__ulat", "__ulon", "__x", "__y", "__z", *_cell(size))
        for axis in "xyz":
            near = near.withColumn("__d", F.explode(around)).withColumn(
                f"c{axis}", F.col(f"c{axis}") + F.col("__d")).drop("__d")
        pairs = near.select("__ulat", "__ulon", "cx", "cy", "cz").join(
            right.select("__plat", "__plon", point, *_cell(size)), ["cx", "cy", "cz"])
        best = (pairs.withColumn("__km", haversine_km(*[F.col(c) for c in ("__ulat", "__ulon", "__plat", "__plon")]))
                .groupBy("__ulat", "__ulon").agg(F.min(F.struct("__km", point)).alias("__m"))
                .select("__ulat", "__ulon", F.col(f"__m.{point}").alias(point),
                        F.col("__m.__km").alias("distancia_km")))
        # chord = 2 sin(angle / 2): sure when it does not exceed the cube side
        sure = best if size >= 2 else best.filter(
            2 * F.sin(F.col("distancia_km") / F.lit(2 * EARTH_RADIUS_KM)) <= F.lit(size))
        sure = ordered.cut(sure)
        done = sure if done is None else done.unionByName(sure)
        left = ordered.cut(left.join(sure.select("__ulat", "__ulon"), ["__ulat", "__ulon"], "left_anti"))
        if size >= 2 or left.isEmpty():
            return done
        size *= 2


def climate_point(dim: DataFrame, points: DataFrame) -> DataFrame:
    """Reference point of each unit: nearest one; without coordinates the first
    of the same state, else of the same subsystem; else none."""
    near = nearest_point(dim, points, "usina_id", "local")
    by_state = points.groupBy(F.col("id_estado").alias("__uf")).agg(F.min("local").alias("__luf"))
    by_sub = points.groupBy(F.col("id_subsistema").alias("__sub")).agg(F.min("local").alias("__lsub"))
    base = (dim.select("usina_id", "id_estado", "regiao", F.col("lat").isNotNull().alias("__has_lat"),
                       F.col("lon").isNotNull().alias("__has_lon"))
            .join(near.withColumnRenamed("local", "__near"), "usina_id", "left")
            .join(by_state, F.col("id_estado") == F.col("__uf"), "left")
            .join(by_sub, F.col("regiao") == F.col("__sub"), "left"))
    located = F.col("__has_lat") & F.col("__has_lon")
    method = (F.when(located & F.col("__near").isNotNull(),
                     F.when(F.col("distancia_km") <= MAX_CLIMATE_KM, "mais_proximo")
                     .otherwise("mais_proximo_distante"))
              .when(located, None)
              .when(F.col("__luf").isNotNull(), "mesma_uf")
              .when(F.col("__lsub").isNotNull(), "mesmo_subsistema"))
    place = F.when(located, F.col("__near")).otherwise(F.coalesce("__luf", "__lsub"))
    return (base.select("usina_id", place.alias("local_clima"), "distancia_km",
                        method.alias("metodo_vinculo_clima"))
            .filter(F.col("local_clima").isNotNull()))


# -------------------------------------------------------------- curve look-ups
def _curve_scan(queries: DataFrame, curve: DataFrame, at: str, time: str, value: str,
                by: Sequence[str], ahead: bool) -> DataFrame:
    """(by, at, `__lo_pt`, `__hi_pt`): last curve point at or before each distinct query
    time and, on request, the next one. One sort per range of time; equal query
    times are looked up once."""
    by = list(by)
    spot = F.struct(F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"))
    left = curve.filter(F.col(time).isNotNull()).select(
        *by, F.col(time).cast("double").alias("__curve_t"), F.lit(0).alias("__lado"), spot.alias("__lo_pt"))
    right = queries.filter(F.col(at).isNotNull()).select(
        *by, F.col(at).cast("double").alias("__curve_t"), F.lit(1).alias("__lado"),
        F.lit(None).cast("struct<t:double,v:double>").alias("__lo_pt")).distinct()
    both = ordered.cut(left.unionByName(right)).withColumn("__o", F.struct("__curve_t", "__lado"))
    both = ordered.add_bucket(both, "__curve_t", ordered.cut_points(both, ["__curve_t"])["__curve_t"], "__bk")
    near = ordered.neighbours(both, by, "__o", ["__lo_pt"], F.col("__bk"), after=ahead)
    return near.filter("__lado = 1").select(*by, "__curve_t", F.col("__before___lo_pt").alias("__lo_pt"), *(
        [F.col("__after___lo_pt").alias("__hi_pt")] if ahead else []))


def _back_to_rows(queries: DataFrame, found: DataFrame, at: str, by: Sequence[str]) -> DataFrame:
    keyed = queries.withColumn("__curve_t", F.col(at).cast("double"))
    return ordered.null_safe(keyed, found, [*by, "__curve_t"], "left")


#: Points of a curve up to which it travels to the tasks.
SMALL_CURVE = 100_000


def _small_curve(queries: DataFrame, curve: DataFrame, at: str, time: str, value: str, by: Sequence[str], line: bool,
                 name: str) -> DataFrame | None:
    """Rows with the value of a curve of few points, found by each task in the points themselves, so that
    no row is shuffled; None for a larger curve, or one with values that are null or not a number."""
    by, spark = list(by), queries.sparkSession
    rows = curve.filter(F.col(time).isNotNull()).select(
        *by, F.col(time).cast("double").alias("__ct"), F.col(value).cast("double").alias("__cv")).limit(SMALL_CURVE + 1).collect()
    if len(rows) > SMALL_CURVE or any(r["__cv"] is None or r["__cv"] != r["__cv"] for r in rows):
        return None
    found: dict = {}
    for r in rows:
        found.setdefault(tuple(r[c] for c in by), []).append((r["__ct"], r["__cv"]))
    points = spark.sparkContext.broadcast([np.array(sorted(x)).T for x in found.values()])

    @F.pandas_udf("double")
    def look(t: pd.Series, g: pd.Series) -> pd.Series:
        t, g, out = t.to_numpy(float), g.to_numpy(), np.full(len(t), np.nan)
        for i in np.unique(g[g >= 0]):
            mine = g == i
            x, v = points.value[int(i)]
            u = t[mine]
            after = np.searchsorted(x, u, side="right")
            before = np.maximum(after - 1, 0)
            if line:
                after = np.minimum(after, len(x) - 1)
                inside = (after > before) & (u > x[before])
                step = np.where(inside, x[after] - x[before], 1.0)
                out[mine] = np.where(inside, v[before] + (v[after] - v[before]) * (np.where(inside, u, 0.0) - np.where(inside, x[before], 0.0)) / step, v[before])
            else:
                out[mine] = np.where(after > 0, v[before], np.nan)
        return pd.Series(out)

    keyed = queries.withColumn("__at", F.col(at).cast("double"))
    if by:
        schema = T.StructType([*[curve.schema[c] for c in by], T.StructField("__g", T.IntegerType())])
        groups = spark.createDataFrame([(*k, i) for i, k in enumerate(found)], schema)
        keyed = ordered.null_safe(keyed, F.broadcast(groups), by, "left")
    else:
        keyed = keyed.withColumn("__g", F.lit(0 if found else -1))
    return keyed.withColumn(name, F.when(F.col("__at").isNotNull(), look("__at", F.coalesce("__g", F.lit(-1)))))


def step_lookup(queries: DataFrame, curve: DataFrame, at: str, time: str, value: str,
                by: Sequence[str] = (), name: str = "valor", before: float | None = None) -> DataFrame:
    """Value of a step curve at a time: the last point at or before it."""
    small = _small_curve(queries, curve, at, time, value, by, False, "__v")
    if small is not None:
        return small.select(*queries.columns, F.when(F.col("__at").isNotNull(), F.coalesce("__v", F.lit(before).cast("double"))).alias(name))
    found = _curve_scan(queries, curve, at, time, value, by, ahead=False)
    result = F.when(F.col("__curve_t").isNotNull(), F.coalesce(F.col("__lo_pt.v"), F.lit(before).cast("double")))
    return _back_to_rows(queries, found, at, by).select(*queries.columns, result.alias(name))


def curve_lookup(queries: DataFrame, curve: DataFrame, at: str, time: str, value: str,
                 by: Sequence[str] = (), name: str = "valor") -> DataFrame:
    """Value of a curve at a time by linear interpolation; both ends clamp."""
    small = _small_curve(queries, curve, at, time, value, by, True, "__v")
    if small is not None:
        return small.select(*queries.columns, F.col("__v").alias(name))
    found = _curve_scan(queries, curve, at, time, value, by, ahead=True)
    p, n, t = F.col("__lo_pt"), F.col("__hi_pt"), F.col("__curve_t")
    line = (F.when(p.isNull(), n["v"]).when(n.isNull(), p["v"])
            .when((n["t"] == p["t"]) | (t == p["t"]), p["v"])
            .otherwise(p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"])))
    return _back_to_rows(queries, found, at, by).select(*queries.columns, line.alias(name))


# ------------------------------------------------------------------- snapshots
def snapshot_changes(before: DataFrame, after: DataFrame, key: str, attribute: str,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Keys whose attribute changed between two snapshots, and keys that are new."""
    old = before.groupBy(key).agg(F.min(attribute).alias("antes")).withColumn("__seen", F.lit(True))
    cols = [*keep, attribute]
    new = (after.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*cols)).alias("__r"))
           .select(key, *[F.col(f"__r.{c}").alias(c) for c in cols]))
    joined = new.join(old, key, "left")
    changed = F.col("__seen").isNull() | F.col("antes").isNull() | ~F.col("antes").eqNullSafe(F.col(attribute))
    return joined.filter(changed).select(
        key, *keep, F.coalesce("antes", F.lit("(não cadastrada)")).alias("fase_antes"),
        F.col(attribute).alias("fase_depois"))


def repeat_daily(hourly: DataFrame, daily: DataFrame, time: str, day: str, by: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """Attach daily values to every hour of the same local day."""
    return (hourly.withColumn("__d", F.to_date(time))
            .join(daily.select(*by, F.col(day).alias("__d"), *columns), [*by, "__d"], "left").drop("__d"))


def since_last_days(fact: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last `days` observed days: the limit is a one-row side."""
    limit = fact.agg((F.max(time) - F.expr(f"INTERVAL {int(days)} DAY")).alias("__corte"))
    return fact.join(F.broadcast(limit), F.col(time) >= F.col("__corte")).drop("__corte")
