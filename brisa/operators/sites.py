"""Choice of climate sites from the registry and the capacity they cover."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from brisa.constants import EARTH_RADIUS_KM, LATITUDE_RANGE, LONGITUDE_RANGE, SOURCE_BY_REGISTRY_CODE, SUBSYSTEM_BY_STATE
from brisa.functions.numeric import haversine_km
from brisa.functions.text import clean_text, map_code, slug, to_number
from brisa.operators import ordered
from brisa.operators.joins import nearest_point
from brisa.session import cut


def near_state_median(df: DataFrame, max_km: float) -> DataFrame:
    """Drop plants farther than `max_km` from the median place of their state."""
    q = ordered.quantiles(df, ["latitude", "longitude"], [0.5], ["id_estado"])
    centre = q.groupBy("id_estado").agg(
        F.max(F.when(F.col("coluna") == "latitude", F.col("valor"))).alias("__lat"),
        F.max(F.when(F.col("coluna") == "longitude", F.col("valor"))).alias("__lon"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"))
    return df.join(centre, "id_estado").filter(km <= max_km).drop("__lat", "__lon")


def candidates(raw: DataFrame, min_mw: float = 1.0, max_state_km: float = 700.0) -> DataFrame:
    """Solar and wind plants in operation with a plausible place and enough power."""
    town = F.trim(F.regexp_replace(F.element_at(F.split("DscMuninicpios", ","), 1), r"\s*-\s*[A-Z]{2}\s*$", ""))
    df = raw.filter(F.col("SigTipoGeracao").isin(*SOURCE_BY_REGISTRY_CODE) & (F.col("DscFaseUsina") == "Operação"))
    df = df.select(
        map_code(F.col("SigTipoGeracao"), SOURCE_BY_REGISTRY_CODE).alias("fonte"),
        clean_text(F.col("SigUFPrincipal")).alias("id_estado"),
        (to_number(F.col("MdaPotenciaFiscalizadaKw")) / 1000).alias("potencia_mw"),
        to_number(F.col("NumCoordNEmpreendimento")).alias("latitude"),
        to_number(F.col("NumCoordEEmpreendimento")).alias("longitude"),
        town.alias("municipio"), F.trim("NomEmpreendimento").alias("usina_referencia"),
        F.trim("CodCEG").alias("ceg"),
    ).withColumn("id_subsistema", map_code(F.col("id_estado"), SUBSYSTEM_BY_STATE))
    df = df.filter(F.col("latitude").between(*LATITUDE_RANGE) & F.col("longitude").between(*LONGITUDE_RANGE)
                   & F.col("id_subsistema").isNotNull() & (F.col("potencia_mw") >= min_mw))
    return near_state_median(df, max_state_km)


def _cells(df: DataFrame, lat: str, lon: str, km: float, around: bool, name: str) -> DataFrame:
    """Equal cells around the unit sphere with a side of `km`; neighbours on request."""
    side = 2 * math.sin(min(km / 6371.0, math.pi) / 2) or 1e-9
    a, o = F.radians(lat), F.radians(lon)
    axes = [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]
    steps = F.array(*[F.lit(d) for d in ((-1, 0, 1) if around else (0,))])
    for i, axis in enumerate(axes):
        df = df.withColumn(f"__d{i}", F.explode(steps)).withColumn(
            f"{name}{i}", F.floor(axis / F.lit(side)).cast("long") + F.col(f"__d{i}")).drop(f"__d{i}")
    return df


#: Plants that come to the driver in one round, and groups they may come from.
OFFERS, GROUPS = 16_384, 256


def _far(plant, taken: list, min_km: float) -> bool:
    """No place of `taken` lies within `min_km` of the plant; an unknown place is near to none."""
    if not taken or plant["latitude"] is None or plant["longitude"] is None:
        return True
    places = np.array([(t["latitude"], t["longitude"]) for t in taken], dtype=float)
    (a, o), (la, lo) = np.radians([plant["latitude"], plant["longitude"]]), np.radians(places).T
    h = np.sin((la - a) / 2) ** 2 + np.cos(a) * np.cos(la) * np.sin((lo - o) / 2) ** 2
    return not (2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(np.sqrt(h), 1.0)) < min_km).any()


def choose(cand: DataFrame, per_group: int = 1, min_group_mw: float = 50.0, min_km: float = 50.0) -> DataFrame:
    """Largest plants of each relevant (source, state), none within `min_km` of a
    chosen one. Groups go by total power; plants by power, then code, then place.

    Each round the first open groups offer their best plants, a bounded number in all, and
    the offers are gone through in the strict order as far as they settle it: up to the first group
    that wants more plants than it offered. Plants near to the new points then leave the pool.
    """
    group, spark = ["fonte", "id_estado"], cand.sparkSession
    totals = (cand.groupBy(*group).agg(F.sum("potencia_mw").alias("total")).filter(F.col("total") >= min_group_mw))
    # the order of groups: larger total first, then name
    pool = cand.join(totals, group).withColumn("vez", F.struct((-F.col("total")).alias("t"), *group))
    pool = pool.withColumn("rank", F.struct((-F.col("potencia_mw")).alias("p"), "ceg", "latitude", "longitude"))
    columns, place = pool.columns, ["vez", "latitude", "longitude"]
    if min_km > 0:          # of the plants of a group at one place only the first can be chosen
        lost = F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), F.col("rank")).alias("__lost")
        rest = [c for c in columns if c not in place]
        pool = pool.groupBy(*place, lost).agg(F.min_by(F.struct(*rest), "rank").alias("r")).select(*place, "r.*")
    pool = cut(pool.select(*columns))
    schema, names, chosen = pool.schema, pool.select(*group).schema, None
    wanted = defaultdict(lambda: per_group)
    while True:
        heads = pool.groupBy("vez", *group).agg(F.count(F.lit(1)).alias("n")).orderBy("vez").limit(GROUPS).collect()
        if not heads:
            break
        per = max(OFFERS // len(heads), 1)
        keys = spark.createDataFrame([tuple(h[c] for c in group) for h in heads], names)
        offers = defaultdict(list)
        for r in (pool.join(F.broadcast(keys), group, "left_semi")
                  .withColumn("__i", F.row_number().over(W.partitionBy("vez").orderBy("rank"))).filter(F.col("__i") <= per)
                  .orderBy("vez", "__i").select(*columns).collect()):
            offers[r["fonte"], r["id_estado"]].append(r)
        taken, settled, halfway = [], [], None
        for h in heads:
            key = h["fonte"], h["id_estado"]
            for plant in offers[key]:
                if not wanted[key]:
                    break
                if _far(plant, taken, min_km):
                    taken.append(plant)
                    wanted[key] -= 1
            if wanted[key] > 0 and h["n"] > len(offers[key]):
                halfway = offers[key][-1]
                break
            settled.append(key)
        points = spark.createDataFrame(taken, schema)
        chosen = cut(points if chosen is None else chosen.unionByName(points))
        if halfway is None and len(heads) < GROUPS:
            break
        # what is settled or near to the new points leaves the pool
        if settled:
            pool = pool.join(F.broadcast(spark.createDataFrame(settled, names)), group, "left_anti")
        if halfway is not None:
            last = spark.createDataFrame([(halfway["vez"], halfway["rank"])], T.StructType(
                [T.StructField("__v", schema["vez"].dataType), T.StructField("__r", schema["rank"].dataType)]))
            pool = pool.join(F.broadcast(last), (F.col("vez") == F.col("__v")) & (F.col("rank") <= F.col("__r")), "left_anti")
        near = _cells(points.select(F.col("latitude").alias("qa"), F.col("longitude").alias("qo")), "qa", "qo", min_km, True, "k")
        cells = _cells(pool, "latitude", "longitude", min_km, False, "k")
        close = (haversine_km(cells["latitude"], cells["longitude"], near["qa"], near["qo"]) < min_km)
        for i in range(3):
            close = close & (cells[f"k{i}"] == near[f"k{i}"])
        pool = cut(cells.join(near, close, "left_anti").select(*columns))
    points = (pool if chosen is None else chosen).drop("vez", "rank", "total").withColumn(
        "local", slug(F.concat_ws("_", "municipio", "id_estado")))
    repeated = points.groupBy("local").agg(F.count(F.lit(1)).alias("__n"))
    return points.join(repeated, "local").select(
        F.when(F.col("__n") > 1, F.concat_ws("_", "local", F.substring("fonte", 1, 3))).otherwise(
            F.col("local")).alias("local"),
        "municipio", "id_estado", "id_subsistema", F.col("fonte").alias("fonte_predominante"),
        F.round("latitude", 5).alias("latitude"), F.round("longitude", 5).alias("longitude"),
        "usina_referencia", F.round("potencia_mw", 3).alias("potencia_mw"), "ceg")


def covered(cand: DataFrame, points: DataFrame, radius_km: float = 300.0, unit: str = "ceg",
            power: str = "potencia_mw", xy: tuple[str, str] = ("latitude", "longitude"),
            point: str = "local") -> DataFrame:
    """One row: sites, distance from plant to site (median, p90, largest) and the
    share of the power within the radius."""
    near = nearest_point(cand, points, unit, point, xy).join(cand.select(unit, power), unit)
    inside = F.sum(F.when(F.col("distancia_km") <= radius_km, F.col(power)).otherwise(0.0))
    sums = near.agg(F.max("distancia_km").alias("distancia_maxima_km"), inside.alias("mw_cobertos"),
                    F.sum(power).alias("mw_total"))
    q = ordered.quantiles_wide(near, "distancia_km", {"distancia_mediana_km": 0.5, "distancia_p90_km": 0.9})
    return (sums.withColumn("pct_coberto", 100 * F.col("mw_cobertos") / F.col("mw_total"))
            .join(F.broadcast(q)))
