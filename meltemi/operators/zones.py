"""Soft zones of locations and similarity weights of donor stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.functions.numeric import clip, gaussian, shares

# Centre and width of each zone in coast_norm, elev_norm and northness.
ZONES = (
    ("N-Coastal", (0.9, 0.05, 0.7), (0.15, 0.15, 0.35)),
    ("S-Coastal", (0.9, 0.05, -0.7), (0.15, 0.15, 0.35)),
    ("Ridge", (0.4, 0.60, 0.0), (0.30, 0.20, 0.50)),
    ("Transitional", (0.6, 0.20, 0.0), (0.35, 0.25, 0.55)),
)
# Where coast and elevation end on their scales, and the weight of an island.
COAST_MAX, ELEV_MAX, ISLAND_BONUS = 1.0, 110.0, 1.5


def log_coast(km: Column) -> Column:
    return F.log1p(clip(km, 0.0))


def normalised(coast_km: Column, elevation: Column, northness: Column) -> list[Column]:
    return [1.0 - clip(log_coast(coast_km), 0.0, COAST_MAX) / COAST_MAX, clip(elevation, 0.0, ELEV_MAX) / ELEV_MAX, F.coalesce(northness, F.lit(0.0))]


def memberships(df: DataFrame, coast: str = "coast_km", elevation: str = "elevation_m", northness: str = "northness") -> DataFrame:
    """df with zone_0 to zone_3, which sum to 1; one projection."""
    x = normalised(F.col(coast), F.col(elevation), F.col(northness))
    df = df.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    raw = []
    for _, centre, sigma in ZONES:
        g = [gaussian(F.col(f"_x{i}") - c, F.lit(s)) for i, (c, s) in enumerate(zip(centre, sigma))]
        raw.append(g[0] * g[1] * g[2])
    df = df.select("*", *[c.alias(f"_z{k}") for k, c in enumerate(raw)])
    out = shares([F.col(f"_z{k}") for k in range(len(ZONES))])
    return df.select("*", *[c.alias(f"zone_{k}") for k, c in enumerate(out)]).drop(*[f"_x{i}" for i in range(3)], *[f"_z{k}" for k in range(len(ZONES))])


def climate_distance(station: list[Column], centre: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(station, centre)), F.lit(0.0)))


def _iqr(c: Column) -> Column:
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    return F.get(q, F.lit(1)) - F.get(q, F.lit(0))


def _weighted(df: DataFrame, keys: list[str], elevation: Column, coast: Column, climate: list[tuple[str, str]]) -> DataFrame:
    """Weights of rows that hold a station's and its target's values; widths are quartile ranges over the stations of a key."""
    df = df.withColumn("_de", elevation).withColumn("_dc", coast).withColumn("_dm", climate_distance(*([F.col(x[i]) for x in climate] for i in (0, 1))))
    sigma = df.groupBy(*keys).agg(_iqr(F.col("_se")).alias("_ie"), _iqr(F.col("_sc")).alias("_ic"), _iqr(F.col("_dm")).alias("_im"))
    df = df.join(F.broadcast(sigma), keys)  # one row for each zone
    raw = gaussian(F.col("_de"), F.col("_ie")) * gaussian(F.col("_dc"), F.col("_ic")) * gaussian(F.col("_dm"), F.col("_im"))
    raw = raw * F.when(F.coalesce(F.col("is_island"), F.lit(False)), F.lit(ISLAND_BONUS)).otherwise(1.0)
    df = df.withColumn("_raw", raw)
    mean = df.groupBy(*keys).agg(F.avg("_raw").alias("_mean"))
    df = df.join(F.broadcast(mean), keys)
    return df.withColumn("weight", F.when(F.col("_mean") == 0, F.lit(1.0)).otherwise(F.col("_raw") / F.nullif(F.col("_mean"), F.lit(0.0))))


def zone_similarity(stations: DataFrame, targets: DataFrame, climate: list[str]) -> DataFrame:
    """(station_id, zone, weight): likeness of each station to each zone's weighted centre of targets, mean 1 in a zone.

    stations and targets have elevation_m, coast_km, is_island and the climate columns; targets also zone_0 to zone_3.
    """
    long = targets.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("zone"), F.col(f"zone_{k}").alias("w")) for k in range(len(ZONES))])).alias("_z")).select("*", "_z.zone", "_z.w")
    w = F.col("w")
    mean = lambda c: F.sum(w * c) / F.nullif(F.sum(w), F.lit(0.0))
    centres = long.groupBy("zone").agg(F.sum(w).alias("_total"), mean(F.col("elevation_m")).alias("_ce"), mean(log_coast(F.col("coast_km"))).alias("_cc"), *[mean(F.col(c)).alias(f"_c_{c}") for c in climate])
    s = stations.withColumn("_se", F.col("elevation_m")).withColumn("_sc", log_coast(F.col("coast_km")))
    # Four rows of centres meet every station.
    df = s.withColumn("zone", F.explode(F.array(*map(F.lit, range(len(ZONES)))))).join(F.broadcast(centres), "zone")
    df = _weighted(df, ["zone"], F.col("_se") - F.col("_ce"), F.col("_sc") - F.col("_cc"), [(c, f"_c_{c}") for c in climate])
    return df.select("station_id", "zone", F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(F.col("weight")).alias("weight"))


def similarity(stations: DataFrame, targets: DataFrame, climate: list[str]) -> DataFrame:
    """(station_id, weight) relative to the plain mean of the targets, coast in km."""
    centre = targets.agg(F.lit(0).alias("zone"), F.avg("elevation_m").alias("_ce"), F.avg("coast_km").alias("_cc"), *[F.avg(c).alias(f"_c_{c}") for c in climate])
    s = stations.withColumn("_se", F.col("elevation_m")).withColumn("_sc", F.col("coast_km")).withColumn("zone", F.lit(0))
    df = s.join(F.broadcast(centre), "zone")
    return _weighted(df, ["zone"], F.col("_se") - F.col("_ce"), F.col("_sc") - F.col("_cc"), [(c, f"_c_{c}") for c in climate]).select("station_id", "weight")


def training_weights(rows: DataFrame, weights: DataFrame, member: DataFrame) -> DataFrame:
    """rows with zone_weight_k = similarity * membership (missing: 1 and one zone's equal share), mean 1 over all rows."""
    wide = weights.groupBy("station_id").agg(*[F.max(F.when(F.col("zone") == k, F.col("weight"))).alias(f"_s{k}") for k in range(len(ZONES))])
    df = rows.join(wide, "station_id", "left").join(member.select("station_id", *[f"zone_{k}" for k in range(len(ZONES))]), "station_id", "left")
    raw = [F.coalesce(F.col(f"_s{k}"), F.lit(1.0)) * F.coalesce(F.col(f"zone_{k}"), F.lit(1.0 / len(ZONES))) for k in range(len(ZONES))]
    df = df.select("*", *[c.alias(f"_r{k}") for k, c in enumerate(raw)])
    means = df.agg(*[F.avg(f"_r{k}").alias(f"_m{k}") for k in range(len(ZONES))])
    df = df.join(F.broadcast(means))  # one row
    return df.select(*rows.columns, *[(F.col(f"_r{k}") / F.col(f"_m{k}")).alias(f"zone_weight_{k}") for k in range(len(ZONES))])


def dominant(columns: list[str]) -> Column:
    """Name of the largest column, the first of equal ones."""
    pairs = F.array(*[F.struct(F.col(c).alias("w"), F.lit(-k).alias("k"), F.lit(c).alias("name")) for k, c in enumerate(columns)])
    return F.array_max(pairs)["name"]
