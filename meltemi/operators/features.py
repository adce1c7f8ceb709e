"""Which columns each variable's models see."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meltemi.operators import learn
from meltemi.operators.spatial import BEARINGS

# The gridded fields that a variable depends on, the most important first.
FIELDS = {
    "tmean": ["tmean", "wind", "u10", "v10"],
    "tmin": ["tmin", "tmean", "u10", "v10"],
    "tmax": ["tmax", "tmean", "u10", "v10"],
    "rh": ["rh", "tmean", "u10", "v10"],
    "precip": ["precip", "rh", "wind", "u10", "v10"],
    "wind": ["wind", "tmean", "u10", "v10"],
    "gust": ["gust", "wind", "u10", "v10"],
}
# What describes season and place.
SEASON_AND_PLACE = ["month_sin", "month_cos", "lat", "lon", "elevation_m"]
COAST = ["coast_dist_km", "is_island", *[f"fetch_{b}_km" for b in BEARINGS]]
HEIGHT = ["delta_elev_m", "lapse_correction_c"]
FINE = ["dem_northness", "dem_eastness", "dem_slope_deg", "tpi_500m", "tpi_2000m", "svf"]


def names(variable: str, grid: str = "grid") -> list[str]:
    """The features of a variable in order; gridded ones begin with the name of their grid.

    Temperatures and humidity see heights, coasts, and the slopes of the grid and of the fine raster. Precipitation and
    wind see the place and its coast; wind and gust also how wind and terrain are aligned, and gust the grid's gust factor.
    """
    if variable not in FIELDS:
        raise KeyError(f"no features of {variable}")
    fields = [f"{grid}_{f}" for f in FIELDS[variable]]
    if variable == "gust":
        fields.append(f"gust_factor_{grid}")
    if variable in ("precip", "wind", "gust"):
        return [*fields, *SEASON_AND_PLACE, *COAST, *(["wind_terrain_align"] if variable != "precip" else [])]
    return [*fields, *SEASON_AND_PLACE, *HEIGHT, *COAST, f"{grid}_northness", f"{grid}_eastness", *FINE]


def matrix(df: DataFrame, variable: str, grid: str = "grid", output: str = "features") -> DataFrame:
    """df with the variable's features as a vector, missing values as NaN; a missing column is an error."""
    wanted = names(variable, grid)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing {', '.join(missing)}")
    numbers = df.withColumns({f"_f{k}": df[c].cast("double") for k, c in enumerate(wanted)})
    return learn.assembled(numbers, [f"_f{k}" for k in range(len(wanted))], output).drop(*[f"_f{k}" for k in range(len(wanted))])
