"""The columns of each variable's models."""

import math

import pytest

from meltemi.operators import features


def test_lists_by_variable():
    assert features.names("gust", "era")[:6] == ["era_gust", "era_wind", "era_u10", "era_v10", "gust_factor_era", "month_sin"]
    assert features.names("gust")[-1] == "wind_terrain_align" == features.names("wind")[-1]
    assert {len(features.names(v)) for v in ("tmean", "tmin", "tmax", "rh")} == {29}
    assert len(features.names("precip")) == 20 and "lapse_correction_c" not in features.names("precip")
    assert all(len(set(features.names(v))) == len(features.names(v)) for v in features.FIELDS)
    with pytest.raises(KeyError):
        features.names("snow")


def test_matrix_keeps_order_and_gaps(spark):
    wanted = features.names("precip")
    row = [None if c == "lat" else c == "is_island" if c == "is_island" else float(k) for k, c in enumerate(wanted)]
    df = spark.createDataFrame([tuple(row)], ", ".join(f"{c} {'boolean' if c == 'is_island' else 'double'}" for c in wanted))
    got = features.matrix(df, "precip")
    v = got.first().features.toArray()
    assert got.columns == [*wanted, "features"]
    for k, c in enumerate(wanted):
        assert math.isnan(v[k]) if c == "lat" else v[k] == (1.0 if c == "is_island" else float(k))
    with pytest.raises(KeyError, match="missing lat"):
        features.matrix(df.drop("lat"), "precip")
