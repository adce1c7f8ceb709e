"""Daily means that equal a threshold are that threshold, whatever the order of their rows."""

import datetime
import itertools

from meltemi.operators.indices import aridities
from meltemi.plans import roles


def test_means_are_exact(spark, tmp_path):
    day = datetime.datetime(1996, 5, 1)
    rows = [(1, day, 30.0, 40000.0, x, 0.0) for x in (0.07, 0.07, 0.01)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    r = roles.obs(spark, str(tmp_path)).first()
    assert (r.obs_wind, r.pred_tmax, r.obs_prcp) == (5.0, 30.0, 10.0)


def test_a_month_whose_mean_is_zero_is_not_warm(spark):
    """Whatever the order of its days: what doubles leave of -1/3 - 1/3 + 2/3 isn't a mean above 0."""
    days = [83 / 3 - 8 - 20, 83 / 3 - 8 - 20, 86 / 3 - 8 - 20]
    rows = [(k, datetime.date(1996, 5, 1 + i), x, 4.0) for k, order in enumerate(itertools.permutations(days)) for i, x in enumerate(order)]
    # Another year has a warm month as well, and April's warmth is what there is.
    rows += [(9, datetime.date(1996, 5, 1 + i), x, 0.0) for i, x in enumerate(days)] + [(9, datetime.date(1996, 4, 1), 5.0, 4.0)]
    df = spark.createDataFrame(rows, "k int, d date, t double, p double").coalesce(1)
    got = {r.k: r.s_aridity for r in aridities(df, ["k"], "d", {"s": ("t", "p")}).collect()}
    assert {got[k] for k in range(6)} == {None}
    a = 6.75e-7 - 7.71e-5 + 1.792e-2 + 0.49239
    assert abs(got[9] - 4 / (16 * 50**a)) < 1e-12
