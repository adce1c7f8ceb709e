"""Empirical quantile mapping.

A transfer is one row: quantiles of model and observations, their means, and the model's wet threshold. Fitting is a
group-by whose arrays are bounded by the calibration window; applying is a join with the transfers, which are few.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.functions.calendar import centres, centres_within, nearest_centre
from meltemi.functions import weather as wx
from meltemi.functions.numeric import clip, interpolated, quantile, quantiles
from meltemi.operators import order
from meltemi.scratch import written

TRANSFER = ["mq", "oq", "obs_mean", "mdl_mean", "wet_thr"]


def fit(df: DataFrame, keys: list[str], obs: str = "obs", mdl: str = "mdl", n: int = 250, precip: bool = False, wet: float = 0.1, null_is_dry: bool = False) -> DataFrame:
    """One transfer by keys, with n_wet, the number of wet observations.

    Means are over all values. For precipitation the model's wet threshold is its quantile at the dry share, and only
    wet values enter the quantiles. With fewer than two values on a side both get one ramp over what the sides hold.
    """
    o, m = F.col(obs).cast("double"), F.col(mdl).cast("double")
    rows = F.count("*") if null_is_dry else F.count(o)
    g = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(o)).alias("_o"),
        F.array_sort(F.collect_list(m)).alias("_m"),
        F.avg(o).alias("obs_mean"),
        F.avg(m).alias("mdl_mean"),
        F.count(F.when(o > wet, 1)).alias("n_wet"),
        rows.alias("_rows"),
    )
    if precip:
        share = F.col("n_wet") / F.nullif(F.col("_rows"), F.lit(0))
        g = g.withColumn("wet_thr", F.when(F.col("n_wet") > 0, F.coalesce(quantile(F.col("_m"), 1 - share), F.lit(0.0))).otherwise(F.lit(0.0)))
        g = g.withColumn("_o", F.filter("_o", lambda v: v > wet)).withColumn("_m", F.filter("_m", lambda v: v > F.col("wet_thr")))
    else:
        g = g.withColumn("wet_thr", F.lit(0.0))
    both = F.concat("_o", "_m")
    lo, hi = F.coalesce(F.array_min(both), F.lit(0.0)), F.coalesce(F.array_max(both), F.lit(1.0))
    g = g.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_few", (F.size("_o") < 2) | (F.size("_m") < 2))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / (n - 1))
    q = lambda c: F.when(F.col("_few"), ramp).otherwise(quantiles(F.col(c), n))
    means = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("obs_mean", "mdl_mean")]
    return g.select(*keys, q("_m").alias("mq"), q("_o").alias("oq"), *means, "wet_thr", "n_wet")


def fit_pools(df: DataFrame, keys: list[str], n: int = 250, wet: float = 0.1, days: list[str] | None = None, pools: Column | None = None) -> DataFrame:
    """As fit() of precipitation (obs, mdl), for pools of any size: quantiles are read by rank and no pool is collected.

    With pools, an array of the pools that a row belongs to by its days, the pool is the last of the keys; rows are counted
    by days and value before they go to their pools, so that repeated values go there once.
    """
    first = days if pools is not None else keys
    o, m = F.col("obs").cast("double"), F.col("mdl").cast("double")
    both = F.array(*[F.struct(F.lit(c).alias("side"), v.alias("v")) for c, v in (("obs", o), ("mdl", m))])
    long = df.select(*first, F.explode(both).alias("_s")).select(*first, "_s.side", "_s.v")
    sums = df.groupBy(*first).agg(F.sum(o).alias("_o"), F.count(o).alias("_rows"), F.sum(m).alias("_m"), F.count(m).alias("_k"), F.count(F.when(o > wet, 1)).alias("n_wet"))
    if pools is None:
        r = order.ranked(long, [*keys, "side"], "v")
    else:
        counted = long.where("v is not null").groupBy(*first, "side", "v").agg(F.count("*").alias("_c"))
        r = order.ranked(counted.withColumn(keys[-1], F.explode(pools)), [*keys, "side"], "v", "_c")
        # As many rows as days.
        sums = sums.withColumn(keys[-1], F.explode(pools)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_o", "_rows", "_m", "_k", "n_wet")])
    mean = lambda s, k: (F.col(s) / F.nullif(F.col(k), F.lit(0)))
    sums = sums.select(*keys, mean("_o", "_rows").alias("obs_mean"), mean("_m", "_k").alias("mdl_mean"), "n_wet", "_rows")
    share = (1 - F.col("n_wet") / F.nullif(F.col("_rows"), F.lit(0))).alias("_q")
    # One row a pool on the right-hand sides from here on.
    thr = order.at_level(r.where("side = 'mdl'").join(sums.where("n_wet > 0").select(*keys, share), keys), keys, F.col("_q"), "wet_thr")
    sums = sums.join(thr, keys, "left").withColumn("wet_thr", F.coalesce("wet_thr", F.lit(0.0)))
    floor = F.when(F.col("side") == "obs", F.lit(wet)).otherwise(F.col("wet_thr"))
    kept = order.above(r.join(sums.select(*keys, "wet_thr"), keys), floor, [*keys, "side"])
    side = lambda c: F.max(F.when(F.col("side") == c, F.col("total")))
    ends = kept.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), *[F.coalesce(side(c), F.lit(0)).alias(f"_{c}") for c in ("obs", "mdl")])
    lists = order.levels(kept, [*keys, "side"], n).groupBy(*keys).pivot("side", ["obs", "mdl"]).agg(F.first("quantiles"))
    out = sums.join(ends, keys, "left").join(lists.withColumnsRenamed({"obs": "_oq", "mdl": "_mq"}), keys, "left")
    lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(1.0))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))
    enough = (F.col("_obs") >= 2) & (F.col("_mdl") >= 2)
    q = lambda c: F.when(enough, F.col(c)).otherwise(ramp)
    means = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("obs_mean", "mdl_mean")]
    return out.select(*keys, q("_mq").alias("mq"), q("_oq").alias("oq"), *means, "wet_thr", "n_wet")


def applied(x: Column, precip: bool = False) -> Column:
    """x mapped by the transfer columns of its row; beyond the calibrated range it moves by the difference of means."""
    mq, oq = F.col("mq"), F.col("oq")
    outside = (x < F.get(mq, F.lit(0))) | (x > F.get(mq, F.size(mq) - 1))
    y = F.when(outside, x + F.col("obs_mean") - F.col("mdl_mean")).otherwise(interpolated(x, mq, oq))
    if not precip:
        return F.when(x.isNotNull(), y)
    return F.when(x <= F.col("wet_thr"), F.lit(0.0)).otherwise(clip(y, 0.0))


def seasonal(target: DataFrame, donors: DataFrame, x: str, out: str, doy: str = "doy", window: int = 45, step: int = 30, least_wet: int = 30, n: int = 200, wet: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """target with x mapped by the transfer of the nearest centre of season.

    donors: keys, doy, obs, mdl. Each donor day is expanded to the few centres within the window and to centre 0, which
    stands for all days. Centres with fewer than least_wet wet observations use the transfer of all days. Pools may hold
    any number of rows.
    """
    keys = keys or []
    at = centres(step)
    valid = donors.where(F.col("obs").isNotNull() & F.col("mdl").isNotNull())
    near = F.concat(F.array(F.lit(0)), centres_within(F.col(doy), at, window, 366))
    fits = written(fit_pools(valid, [*keys, "centre"], n, wet, [*keys, doy], near), "transfers")
    by = fits.where((F.col("n_wet") >= least_wet) & (F.col("centre") > 0)).select(*keys, "centre", F.struct(*TRANSFER).alias("_by"))
    whole = fits.where("centre = 0").select(*keys, F.struct(*TRANSFER).alias("_all"))
    if not keys:
        by, whole = F.broadcast(by), F.broadcast(whole)  # as many rows as centres
    t = target.withColumn("centre", nearest_centre(F.col(doy), at, 366)).join(by, [*keys, "centre"], "left")
    t = t.join(whole, keys, "left") if keys else t.join(whole, how="left")
    t = t.withColumn("_t", F.coalesce("_by", "_all")).select("*", *[F.col(f"_t.{c}").alias(c) for c in TRANSFER])
    return t.withColumn(out, applied(F.col(x), True)).drop("centre", "_by", "_all", "_t", *TRANSFER)


def blend(mapped_baseline: Column, source: Column, alpha: float = 0.6) -> Column:
    return clip(alpha * mapped_baseline + (1 - alpha) * source, 0.0)


def _mapped(x: np.ndarray, obs: np.ndarray, mdl: np.ndarray, precip: bool, n: int, wet: float) -> np.ndarray:
    """x by the transfer of one window; NaN where a side of the window has no values."""
    om, mm = (np.nanmean(v) if np.isfinite(v).any() else 0.0 for v in (obs, mdl))
    rows, o, m = len(obs), obs[np.isfinite(obs)], mdl[np.isfinite(mdl)]
    if not len(o) or not len(m):
        return np.full(len(x), np.nan)
    thr = 0.0
    if precip:
        share = (o > wet).sum() / rows
        thr = np.quantile(m, 1 - share) if share > 0 else 0.0
        o, m = o[o > wet], m[m > thr]
    if len(o) < 2 or len(m) < 2:
        both = np.concatenate([o, m])
        oq = mq = np.linspace(both.min(), both.max(), n) if len(both) else np.linspace(0, 1, n)
    else:
        p = np.linspace(0, 1, n)
        oq, mq = np.quantile(o, p), np.quantile(m, p)
    y = np.interp(x, mq, oq)
    far = (x < mq[0]) | (x > mq[-1])
    y[far] = x[far] + om - mm
    if precip:
        y = np.where(x <= thr, 0.0, np.maximum(y, 0.0))
    return np.where(np.isfinite(x), y, np.nan)


def _near(doy: np.ndarray, d: int, window: int, length: int) -> np.ndarray:
    gap = np.abs(doy - d)
    return np.minimum(gap, length - gap) <= window


def projection(df: DataFrame, keys: list[str], window: int = 15, length: int = 365, n: int = 250, precip: bool = False, wet: float = 0.1) -> DataFrame:
    """Day-of-year mapping of whole series: df has keys, doy, period ('cal' or 'fut'), obs, mdl; adds corrected.

    Every series (one model, variable and point) is shuffled once and its windows slide in memory; the expansion of
    fit() by window would multiply the rows thirty-fold. Days without calibration values stay null.
    """
    names = df.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        doy, cal = part["doy"].to_numpy(), (part["period"] == "cal").to_numpy()
        obs, mdl = part["obs"].to_numpy(float), part["mdl"].to_numpy(float)
        out = np.full(len(part), np.nan)
        for d in np.unique(doy):
            near, at = cal & _near(doy, d, window, length), doy == d
            out[at] = _mapped(mdl[at], obs[near], mdl[near], precip, n, wet)
        return part.assign(corrected=[None if np.isnan(v) else v for v in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", corrected double"
    return df.select(*names).groupBy(*keys).applyInPandas(run, schema)


#: Variables of an ensemble, and which of them is precipitation.
VARIABLES = {"tmean": False, "tmin": False, "tmax": False, "rh": False, "wind": False, "precip": True}


def blended_onto(df: DataFrame, donors: DataFrame | None, baseline: str = "baseline", source: str = "precip_best", out: str = "precip_best_eqm", alpha: float = 0.6, **options) -> DataFrame:
    """df with out: alpha parts of the mapped baseline and the rest of the source, at every place by the same donors.

    df is given back as it is where there are no donors or none with both values, or where df lacks one of the columns.
    """
    if donors is None or not {baseline, source} <= set(df.columns):
        return df
    if donors.where(F.col("obs").isNotNull() & F.col("mdl").isNotNull()).isEmpty():
        return df
    return seasonal(df, donors, baseline, "_mapped", **options).withColumn(out, blend(F.col("_mapped"), F.col(source), alpha)).drop("_mapped")


def ensemble(truth: DataFrame, series: DataFrame, historical: str = "historical", variables: list[str] | None = None, window: int = 15, n: int = 250, wet: float = 0.1) -> DataFrame:
    """series with every variable that truth has too corrected by its model's own calendar, point by point.

    truth: point, doy (1 to 365) and variables, of the calibration years. series: model, scenario, point, date, doy,
    calendar ('360_day', whose doy is 1 to 360, or any other) and variables; rows of the scenario `historical` with
    calibrating = true are what truth is compared with. A day of a 360-day calendar looks up the truth around the
    matching day of the year. Variables that only series has stay as they are. Humidity stays within 0 and 100, wind
    and precipitation at or above 0, and tmin and tmax on their sides of tmean. Days whose window lacks either side
    become null.
    """
    own = [v for v in VARIABLES if v in truth.columns and v in series.columns and (variables is None or v in variables)]
    if not own:
        return series
    narrow = lambda df, *keep: df.select(*keep, F.explode(F.create_map(*[x for v in own for x in (F.lit(v), F.col(v).cast("double"))])).alias("variable", "x"))
    keys = ["model", "scenario", "point", "date"]
    sim = narrow(series, *keys, "doy", F.coalesce(F.col("calendar") == "360_day", F.lit(False)).alias("short"), ((F.col("scenario") == historical) & F.col("calibrating")).alias("cal"))
    # Every model of a point meets the point's truth; the two sides of a group are one series each.
    models = series.select(F.col("model").alias("m"), F.col("point").alias("p")).distinct()
    obs = narrow(truth, "point", "doy").join(models, F.col("point") == F.col("p")).select("m", "p", F.col("variable").alias("v"), F.col("doy").alias("at"), F.col("x").alias("o"))
    kinds = {f.name: f.dataType.simpleString() for f in sim.schema}

    def run(obs: pd.DataFrame, sim: pd.DataFrame) -> pd.DataFrame:
        out = np.full(len(sim), np.nan)
        if len(sim) and len(obs):
            precip = VARIABLES[sim["variable"].iloc[0]]
            length = 360 if sim["short"].iloc[0] else 365
            doy, x, cal = sim["doy"].to_numpy(), sim["x"].to_numpy(float), sim["cal"].fillna(False).to_numpy(bool)
            at_obs, o = obs["at"].to_numpy(), obs["o"].to_numpy(float)
            for d in np.unique(doy):
                year_day = int(min(365, max(1, np.round((d - 0.5) / 360 * 365 + 0.5)))) if length == 360 else int(d)
                mine, theirs = cal & _near(doy, d, window, length), _near(at_obs, year_day, window, 365)
                if mine.any() and theirs.any():
                    out[doy == d] = _mapped(x[doy == d], o[theirs], x[mine], precip, n, wet)
        return sim[[*keys, "variable"]].assign(y=[None if np.isnan(v) else v for v in out])

    long = obs.groupBy("m", "p", "v").cogroup(sim.groupBy("model", "point", "variable")).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "variable"]) + ", y double")
    wide = long.groupBy(*keys).pivot("variable", own).agg(F.first("y"))
    out = series.drop(*own).join(wide, keys, "left")
    out = out.withColumns({v: wx.limited(v, F.col(v)) for v in own if v in ("rh", "wind", "precip")})
    if {"tmin", "tmean", "tmax"} <= set(own):
        lo, hi = wx.ordered_temperatures(F.col("tmin"), F.col("tmean"), F.col("tmax"))
        out = out.withColumns({"tmin": lo, "tmax": hi})
    return out.select(*series.columns)


def without_each(df: DataFrame, key: str, folds: DataFrame) -> DataFrame:
    """(fold, n, obs_mean) of all rows but the fold's own: the sums of everything less those of the fold."""
    by = df.groupBy(key).agg(F.count("*").alias("_n"), F.sum("obs").alias("_s"))
    whole = by.agg(F.sum("_n").alias("_wn"), F.sum("_s").alias("_ws"))
    j = folds.join(by, key).join(F.broadcast(whole))  # one row
    n = F.col("_wn") - F.col("_n")
    return j.select(F.col(key).alias("fold"), n.alias("n"), F.round((F.col("_ws") - F.col("_s")) / n, 6).alias("obs_mean"))


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled whatever its estimated size.

    Tables of one list of quantiles a fold compress to a small part of their size, by which Spark would take them for small
    ones and gather them on the driver.
    """
    return df.hint("merge")


def _without(all_: DataFrame, own: DataFrame, requests: DataFrame, block: int = 256) -> DataFrame:
    """requests (fold, side, tag, r) with v, the value of rank r among all values but the fold's own, and `upto`, how many of these are at most v.

    all_: side, v, c, start of everything; own: fold, side, a, c, own_start, own_c, the fold's own values with their rank
    and number in everything. From its own value on, a fold's ranks lag behind those of everything by the own values
    passed. Each own value is handed to the first of the fold's requests, a few hundred at most, whose rank has reached
    its turn, and holds from there on.
    """
    lists = requests.groupBy("fold", "side").agg(F.sort_array(F.collect_list(F.struct("r", "tag"))).alias("rs"))
    turns = own.withColumn("turn", F.col("a") - F.col("own_start")).join(_shuffled(lists), ["fold", "side"])
    turns = turns.withColumn("i", F.size(F.filter("rs", lambda x: x["r"] < F.col("turn")))).where(F.col("i") < F.size("rs"))
    turns = turns.groupBy("fold", "side", "i").agg(F.max(F.struct("own_start", "turn", "c", "own_c")).alias("k"))
    q = lists.select("fold", "side", F.posexplode("rs").alias("i", "x")).join(_shuffled(turns), ["fold", "side", "i"], "left")
    so_far = Window.partitionBy("fold", "side").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    q = q.select("fold", "side", "x.r", "x.tag", F.max("k").over(so_far).alias("k"))
    k = lambda c: F.coalesce(F.col(f"k.{c}"), F.lit(0))
    own_upto = k("own_start") + k("own_c")
    at_own = F.col("k").isNotNull() & (F.col("r") < k("turn") + k("c") - k("own_c"))
    q = q.select("fold", "side", "tag", "r", own_upto.alias("own_upto"), (F.col("r") + F.when(at_own, k("own_start")).otherwise(own_upto)).alias("rank"))
    # A rank meets the value that covers it in a block of ranks.
    q = q.withColumn("b", F.floor(F.col("rank") / block))
    spans = all_.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("c") - 1) / block))))
    j = q.join(_shuffled(spans), ["side", "b"]).where("rank >= start and rank < start + c")
    return j.select("fold", "side", "tag", "r", "v", (F.col("start") + F.col("c") - F.col("own_upto")).alias("upto"))


def leave_one_out(df: DataFrame, key: str, folds: DataFrame, n: int = 200, wet: float = 0.1) -> DataFrame:
    """Rows of each fold with `mapped`, by the transfer of all other rows.

    The pools of all folds differ by one fold's rows each, so they aren't written out: values are ranked once over
    everything and once within each fold, and a rank of a pool is a rank of everything moved by the own values before
    it. Nothing passes through the driver, and no pool or fold is collected.
    """
    both = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("v")) for c in ("obs", "mdl")])
    d = df.where(F.col("obs").isNotNull() & F.col("mdl").isNotNull()).withColumn("fold", F.col(key))
    long = d.select("fold", F.explode(both).alias("_s")).select("fold", "_s.side", "_s.v")
    all_ = written(order.ranked(long, ["side"], "v"), "ranks")
    names = folds.select(F.col(key).alias("fold")).distinct()
    own = order.ranked(long.join(_shuffled(names), "fold", "left_semi"), ["fold", "side"], "v").select("fold", "side", "v", F.col("c").alias("own_c"), F.col("start").alias("own_start"))
    own = written(own.join(_shuffled(all_.select("side", "v", "c", F.col("start").alias("a"))), ["side", "v"]), "own")
    # Of everything one row, of the folds one each.
    o, m = F.col("obs").cast("double"), F.col("mdl").cast("double")
    sums = [F.count("*").alias("n"), F.sum(o).alias("o"), F.sum(m).alias("m"), F.count(F.when(o > wet, 1)).alias("w")]
    whole = d.agg(*sums).select(*[F.col(c).alias(f"all_{c}") for c in "nomw"])
    pool = names.join(_shuffled(d.groupBy("fold").agg(*sums)), "fold", "left").join(F.broadcast(whole)).fillna(0)
    pool = pool.select("fold", *[(F.col(f"all_{c}") - F.col(c)).alias(c) for c in "nomw"])
    share = F.when(F.col("w") > 0, 1 - F.col("w") / F.col("n"))
    at = share * (F.col("n") - 1)
    ends = F.array(*[F.struct(F.lit(t).alias("tag"), F.least(F.floor(at) + t, F.col("n") - 1).alias("r")) for t in (0, 1)])
    asked = pool.where("w > 0").select("fold", F.lit("mdl").alias("side"), F.explode(ends).alias("e"), at.alias("at")).select("fold", "side", "e.*", "at")
    found = _without(all_, own, asked.select("fold", "side", "tag", "r"))
    pick = lambda c, t: F.max(F.when(F.col("tag") == t, F.col(c)))
    thr = found.groupBy("fold").agg(*[pick(c, t).alias(f"{c}{t}") for c in ("v", "upto") for t in (0, 1)]).join(_shuffled(pool.select("fold", at.alias("at"))), "fold")
    y = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.floor("at"))
    thr = thr.select("fold", y.alias("wet_thr"), F.when(F.col("v1") <= y, F.col("upto1")).otherwise(F.col("upto0")).alias("low"))
    # Without a wet day the threshold is 0, and the values up to it are counted.
    dry = pool.where("w = 0").select("fold").join(own.where("side = 'mdl' and v <= 0").groupBy("fold").agg(F.sum("own_c").alias("own")).hint("merge"), "fold", "left")
    zero = all_.where("side = 'mdl' and v <= 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("z"))  # one row
    dry = dry.join(F.broadcast(zero)).select("fold", F.lit(0.0).alias("wet_thr"), (F.col("z") - F.coalesce("own", F.lit(0))).alias("low"))
    pool = written(pool.join(_shuffled(thr.unionByName(dry)), "fold"), "pools")
    sides = F.array(F.struct(F.lit("obs").alias("side"), (F.col("n") - F.col("w")).alias("low")), F.struct(F.lit("mdl").alias("side"), F.col("low").alias("low")))
    kept = pool.select("fold", "n", F.explode(sides).alias("s")).select("fold", "s.*", (F.col("n") - F.col("s.low")).alias("size")).where("size > 0")
    place = (F.col("i") / (n - 1)) * (F.col("size") - 1)
    kept = kept.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", place - F.floor(place))
    ends = F.array(*[F.struct((F.col("i") * 2 + t).alias("tag"), (F.col("low") + F.least(F.floor(place) + t, F.col("size") - 1)).alias("r")) for t in (0, 1)])
    kept = kept.select("fold", "side", "size", "i", "t", F.explode(ends).alias("e")).select("fold", "side", "size", "i", "t", "e.*")
    found = _without(all_, own, kept.select("fold", "side", "tag", "r")).join(_shuffled(kept), ["fold", "side", "tag"]).groupBy("fold", "side", "size", "i", "t").agg(*[F.max(F.when(F.col("tag") % 2 == t, F.col("v"))).alias(f"v{t}") for t in (0, 1)])
    lists = found.groupBy("fold", "side", "size").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("t")).alias("q")))).alias("l"))  # n entries
    lists = lists.select("fold", "side", "size", F.transform("l", lambda x: x["q"]).alias("q"))
    t = pool.select("fold", "n", "o", "m", "wet_thr")
    for c in ("obs", "mdl"):
        t = t.join(_shuffled(lists.where(F.col("side") == c).select("fold", F.col("size").alias(f"n_{c}"), F.col("q").alias(f"q_{c}"))), "fold", "left")
    # greatest and least skip null, so one side's ends do where the other holds nothing.
    lo = F.coalesce(F.least(F.get("q_obs", F.lit(0)), F.get("q_mdl", F.lit(0))), F.lit(0.0))
    hi = F.coalesce(F.greatest(F.get("q_obs", F.lit(n - 1)), F.get("q_mdl", F.lit(n - 1))), F.lit(1.0))
    ramp = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))
    enough = F.coalesce((F.col("n_obs") >= 2) & (F.col("n_mdl") >= 2), F.lit(False))
    mean = lambda c: F.coalesce(F.col(c) / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    t = t.select(F.col("fold").alias(key), F.when(enough, F.col("q_mdl")).otherwise(ramp).alias("mq"), F.when(enough, F.col("q_obs")).otherwise(ramp).alias("oq"), mean("o").alias("obs_mean"), mean("m").alias("mdl_mean"), "wet_thr")
    return df.join(_shuffled(t), key).withColumn("mapped", applied(F.col("mdl"), True)).drop(*TRANSFER)
