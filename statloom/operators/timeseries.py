"""Series per group: gaps, frequency, change points, decomposition and forecasts.

Rows of a series are numbered with bucketed running counts, so a series may hold a third
of the table. Sequential kernels run on pieces of bounded length with an overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.missing import epoch_seconds, moment, number
from statloom.functions.ordered import BUCKET, Cuts, exact_quantile, find_cuts, previous_row, running_sums, with_buckets
from statloom.functions.series import JUMP, OUTER, OUTLIER_SCALE, design, pelt, stl, stl_reach, stl_round
from statloom.operators.relational import union_all
from statloom.result import ProfileResult, quoted, require_columns
from statloom.session import cut_lineage

DAY = 86400.0
# Upper bounds of the median gap in days with the frequency / the seasonal period (fixed values).
FREQUENCIES = [(1.5, "D"), (8.0, "W"), (35.0, "MS"), (100.0, "QS"), (None, "YS")]
PERIODS = [(1.5, 7), (8.0, 52), (35.0, 12), (100.0, 4), (None, 2)]
DEFAULT_PERIOD = 12
# Piece length and overlap (rows) for the sequential kernels.
PIECE = {"l2": 20_000, "l1": 2_000, "rbf": 2_000}
PIECE_OVERLAP = 250
STL_PIECE = 20_000
KNOTS, RIDGE, INTERVAL_Z = 10, 1e-6, 1.2815515655446004


def _series(df: DataFrame, date: str, value: str | None, group: str | None) -> DataFrame:
    """(series, ds, y): one NULL-free series key, rows without a date left out."""
    key = F.col(quoted(group)).cast("string") if group else F.lit("all")
    y = number(df, value) if value else F.lit(None).cast("double")
    return df.select(key.alias("series"), moment(df, date).alias("ds"), y.alias("y")).filter("series is not null and ds is not null")


def median_gap_days(series: DataFrame, distinct_days: bool, rows_per_bucket: int | None = None) -> DataFrame:
    """Median gap between neighbouring dates per series, NULL where there is one date.

    Repeated dates are collapsed with their count first: their zero gaps are added back as
    one counted value, so a date of any weight stays one row.
    """
    dates = series.groupBy("series", "ds").agg(F.count("*").alias("n"))
    linked = cut_lineage(previous_row(dates, ["series"], ["ds"], {"before": "ds"}, rows_per_bucket))  # read four times
    seconds = epoch_seconds(F.col("ds")) - epoch_seconds(F.col("before"))
    days = F.floor(seconds / DAY).cast("double") if distinct_days else seconds / DAY
    gaps = linked.select("series", days.alias("gap"), F.lit(1).alias("n")).filter("gap is not null")
    if not distinct_days:
        zeros = linked.filter("n > 1").select("series", F.lit(0.0).alias("gap"), (F.col("n") - 1).alias("n"))
        gaps = gaps.unionByName(zeros)
    counted = cut_lineage(gaps.groupBy("series", "gap").agg(F.sum("n").alias("n")))
    below = running_sums(counted, ["series"], ["gap"], {"below": F.col("n")}, inclusive=False, rows_per_bucket=rows_per_bucket)
    total = counted.groupBy("series").agg(F.sum("n").alias("total"))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col("gap")))
    median = below.join(total, "series").groupBy("series").agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    every = linked.select("series").distinct()
    return every.join(median, "series", "left").select("series", ((F.col("_lo") + F.col("_hi")) / 2).alias("median_days"))


def _banded(days: Column, table: list) -> Column:
    out = None
    for bound, value in table:
        if bound is None:
            return out.otherwise(value)
        out = (F if out is None else out).when(days <= bound, value)
    return out


def infer_frequency(df: DataFrame, date_column: str, group_column: str | None = None) -> DataFrame:
    """Frequency per series from the median gap in whole days; one date counts as monthly."""
    require_columns(df, date_column=date_column)
    gaps = median_gap_days(_series(df, date_column, None, group_column), True)
    freq = F.when(F.col("median_days").isNull(), "MS").when(F.col("median_days") > 0, _banded(F.col("median_days"), FREQUENCIES))
    return gaps.withColumn("frequency", freq)


def infer_period(df: DataFrame, date_column: str, group_column: str | None = None) -> DataFrame:
    """Seasonal period per series from the median gap between rows."""
    require_columns(df, date_column=date_column)
    gaps = median_gap_days(_series(df, date_column, None, group_column), False)
    period = F.when(F.col("median_days").isNull(), DEFAULT_PERIOD).otherwise(_banded(F.col("median_days"), PERIODS))
    return gaps.withColumn("period", period)


def _step(freq: Column, i: Column) -> Column:
    months = F.when(freq == "MS", 1).when(freq == "QS", 3).when(freq == "YS", 12)
    return months * i


def future_dates(df: DataFrame, date_column: str, periods: int, group_column: str | None = None) -> DataFrame:
    """The next dates of each series at its frequency: days, Sundays, or period starts."""
    if not 1 <= periods <= 1000:
        raise ValueError("periods must be between 1 and 1000")
    series = _series(df, date_column, None, group_column)
    last = series.groupBy("series").agg(F.max("ds").alias("last"))
    freq = infer_frequency(df, date_column, group_column).select("series", "frequency")
    steps = last.join(freq, "series").filter("frequency is not null").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    f, i, day = F.col("frequency"), F.col("i"), F.to_date("last")
    to_sunday = F.pmod(F.lit(8) - F.dayofweek("last"), F.lit(7))
    first_sunday = F.date_add(day, F.when(to_sunday == 0, 7).otherwise(to_sunday).cast("int"))
    anchor = (
        F.when(f == "MS", F.trunc(day, "month")).when(f == "QS", F.trunc(day, "quarter")).otherwise(F.trunc(day, "year"))
    )
    calendar = F.add_months(anchor, _step(f, i).cast("int")).cast("timestamp_ntz")
    ds = (
        F.when(f == "D", F.col("last") + F.make_dt_interval(days=i))
        .when(f == "W", F.date_add(first_sunday, 7 * (i - 1)).cast("timestamp_ntz"))
        .otherwise(calendar)
    )
    return steps.select("series", "i", ds.alias("ds"))


# --- numbering and filling --------------------------------------------------------------


def _numbered_rows(df: DataFrame, date: str, value: str, group: str | None, id_column: str, rows_per_bucket):
    """Rows with series key, value and position in date order (id decides equal dates)."""
    key = F.col(quoted(group)).cast("string") if group else F.lit("all")
    staged = df.withColumns({"_series": key, "_ds": moment(df, date), "_y": number(df, value), "_id": F.col(quoted(id_column))})
    cuts = find_cuts(staged, ["_ds", "_id"], rows_per_bucket)
    placed = running_sums(staged, ["_series"], ["_ds", "_id"], {"_pos": F.lit(1).cast("long")}, inclusive=False, cuts=cuts)
    return placed, cuts


def _neighbours(placed: DataFrame, cuts: Cuts) -> DataFrame:
    """Last known and next known value and position around every row."""
    known = F.when(F.col("_y").isNotNull(), F.struct("_pos", "_y"))
    cut = with_buckets(placed, ["_ds", "_id"], cuts)
    forward = Window.partitionBy("_series", BUCKET).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    # from the end backwards: a frame up to the last row would be read again for every row
    backward = Window.partitionBy("_series", BUCKET).orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    prev, after = F.last(known, ignorenulls=True).over(forward), F.last(known, ignorenulls=True).over(backward)
    out = cut.withColumns({"_prev": prev, "_next": after})
    if not cuts.single:
        ends = cut.filter("_y is not null").groupBy("_series", BUCKET).agg(
            F.min(F.struct("_pos", "_y")).alias("_first"), F.max(F.struct("_pos", "_y")).alias("_last")
        )
        buckets = cut.select("_series", BUCKET).distinct().join(ends, ["_series", BUCKET], "left")
        before = Window.partitionBy("_series").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy("_series").orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = buckets.select(
            "_series",
            BUCKET,
            F.last("_last", ignorenulls=True).over(before).alias("_cp"),
            F.last("_first", ignorenulls=True).over(behind).alias("_cn"),
        )
        out = out.join(carry, ["_series", BUCKET], "left").withColumns(
            {"_prev": F.coalesce("_prev", "_cp"), "_next": F.coalesce("_next", "_cn")}
        ).drop("_cp", "_cn")
    return out.drop(BUCKET)


def _filled(linear: bool) -> Column:
    """Value with gaps closed: by the line between neighbours, or by the last value."""
    p, n = F.col("_prev"), F.col("_next")
    if linear:
        between = p["_y"] + (n["_y"] - p["_y"]) * (F.col("_pos") - p["_pos"]) / (n["_pos"] - p["_pos"])
        return F.coalesce("_y", between, p["_y"], n["_y"])
    return F.coalesce("_y", p["_y"], n["_y"])


def fill_gaps(
    df: DataFrame,
    date_column: str,
    value_column: str,
    id_column: str,
    group_column: str | None = None,
    method: str = "ffill",
    rows_per_bucket: int | None = None,
) -> ProfileResult:
    """Close missing values per series: forward then backward fill, or linear interpolation."""
    if method not in ("ffill", "linear"):
        raise ValueError("method must be 'ffill' or 'linear'")
    require_columns(df, columns=[date_column, value_column, id_column])
    placed, cuts = _numbered_rows(df, date_column, value_column, group_column, id_column, rows_per_bucket)
    filled = _neighbours(placed, cuts).withColumn("filled_value", _filled(method == "linear"))
    return ProfileResult(filled.select(*[quoted(c) for c in df.columns], "filled_value"))


# --- change points ----------------------------------------------------------------------


def _piece_rows(rows: DataFrame, length: int, overlap: int) -> DataFrame:
    """Copy rows into the pieces they belong to, neighbours included on both sides.

    A piece has at most ``length + 2 * overlap`` rows, whatever the series length.
    """
    own = F.floor(F.col("_pos") / length)
    start = F.floor((F.col("_pos") - overlap) / length)
    end = F.floor((F.col("_pos") + overlap) / length)
    return rows.withColumn("_piece", F.explode(F.sequence(F.greatest(start, F.lit(0)), end))).withColumn(
        "_core", F.col("_piece") == own
    )


def _segment(model: str, min_size: int):
    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("_pos")
        first, penalty = int(piece["_pos"].iloc[0]), float(piece["_penalty"].iloc[0])
        y = piece["_f"].to_numpy(dtype=float)
        # ends stay on one grid over the whole series
        shift = -first % JUMP
        cuts = [c + shift for c in pelt(y[shift:], model, min_size, penalty)]
        core = piece["_core"].to_numpy()
        ends = [first + c for c in cuts if core[c]]
        return pd.DataFrame({"_series": piece["_series"].iloc[0], "_pos": np.array(ends, dtype="int64")})

    return run


def change_points(
    df: DataFrame,
    date_column: str,
    value_column: str,
    id_column: str,
    group_column: str | None = None,
    min_segment_length: int = 3,
    model: str = "rbf",
    penalty: float | None = None,
    rows_per_bucket: int | None = None,
    piece: int | None = None,
) -> ProfileResult:
    """Structural breaks per series by penalised optimal partitioning.

    The default penalty is ln(n) times the population variance. Series up to one piece
    are solved as a whole; longer ones in overlapping pieces, each keeping the breaks in
    its own part. ``segment_id`` counts the breaks strictly before a row.
    """
    if model not in PIECE:
        raise ValueError("model must be 'rbf', 'l2', or 'l1'")
    require_columns(df, columns=[date_column, value_column, id_column])
    placed, cuts = _numbered_rows(df, date_column, value_column, group_column, id_column, rows_per_bucket)
    rows = cut_lineage(_neighbours(placed, cuts).withColumn("_f", _filled(False)).drop("_prev", "_next"))
    sizes = rows.groupBy("_series").agg(F.count("*").alias("_n"), F.var_pop("_f").alias("_var"))
    auto = F.log(F.col("_n")) * F.col("_var") if penalty is None else F.lit(float(penalty))
    sized = sizes.withColumn("_penalty", F.greatest(auto, F.lit(1e-6))).filter(F.col("_n") >= 2 * min_segment_length)
    length = piece or PIECE[model]
    pieces = _piece_rows(rows.filter("_f is not null").select("_series", "_pos", "_f"), length, min(PIECE_OVERLAP, length // 4))
    found = (
        pieces.join(sized.select("_series", "_penalty"), "_series")
        .groupBy("_series", "_piece")
        .applyInPandas(_segment(model, min_segment_length), "_series string, _pos long")
    )
    breaks = cut_lineage(found.distinct().withColumn("_hit", F.lit(True)))
    marked = rows.join(breaks, ["_series", "_pos"], "left").withColumn("change_point", F.coalesce("_hit", F.lit(False)))
    counted = running_sums(
        marked, ["_series"], ["_ds", "_id"], {"segment_id": F.col("change_point").cast("int")}, inclusive=False, cuts=cuts
    )
    columns = [quoted(c) for c in df.columns]
    points = counted.filter("change_point").select(
        F.col("_series").alias("group"), F.col("_pos").alias("position"), F.col("_ds").cast("string").alias("date")
    )
    result = counted.select(*columns, "change_point", F.col("segment_id").cast("int").alias("segment_id"))
    return ProfileResult(result, {"change_points": points}, breaks.agg(F.count("*").alias("n_change_points")))


def segment_ids(df: DataFrame, flag: str, order: list[str], keys: list[str] = (), rows_per_bucket: int | None = None) -> DataFrame:
    """Number of flagged rows strictly before each row of the same key."""
    return running_sums(
        df, list(keys), order, {"segment_id": F.col(flag).cast("int")}, inclusive=False, rows_per_bucket=rows_per_bucket
    )


# --- decomposition ----------------------------------------------------------------------


PARTS = "trend double, seasonal double, residual double"


def _decompose_whole(series: pd.DataFrame) -> pd.DataFrame:
    series = series.sort_values("_pos")
    trend, seasonal, residual = stl(series["_f"].to_numpy(dtype=float), int(series["_period"].iloc[0]))
    return pd.DataFrame({"_series": series["_series"], "_pos": series["_pos"], "trend": trend, "seasonal": seasonal, "residual": residual})


def _round_of_piece(piece: pd.DataFrame) -> pd.DataFrame:
    """One round of smoothing on the rows of a piece; a series without residuals is left as it is."""
    piece = piece.sort_values("_pos")
    if not piece["_fits"].iloc[0]:
        y, start = piece["_f"].to_numpy(dtype=float), int(piece["_pos"].iloc[0])
        period, whole = int(piece["_period"].iloc[0]), int(piece["_n"].iloc[0])
        trend, seasonal = stl_round(y, piece["trend"].to_numpy(dtype=float), piece["_rho"].to_numpy(dtype=float), period, start % period, whole)
        piece = piece.assign(trend=trend, seasonal=seasonal)
    return piece.loc[piece["_core"], ["_series", "_pos", "_f", "_period", "_n", "trend", "seasonal", "_fits"]]


def _decompose_rounds(values: DataFrame, piece: int, reach: int, rows_per_bucket: int | None) -> DataFrame:
    """The decomposition of series of any length, a round at a time.

    A round runs on pieces with the rows that their values depend on, so it gives what the
    whole series would. The scale that decides what an outlier is, is the exact median of
    the whole series' residuals, found between the rounds.
    """
    state = values.withColumns({"trend": F.lit(0.0), "seasonal": F.lit(0.0), "_rho": F.lit(1.0), "_fits": F.lit(False)})
    shape = "_series string, _pos long, _f double, _period int, _n long, trend double, seasonal double, _fits boolean"
    residual = F.col("_f") - F.col("trend") - F.col("seasonal")
    for step in range(OUTER + 1):
        pieces = _piece_rows(state, piece, reach)
        smoothed = cut_lineage(pieces.groupBy("_series", "_piece").applyInPandas(_round_of_piece, shape))
        if step == OUTER:
            return smoothed.select("_series", "_pos", "trend", "seasonal", residual.alias("residual"))
        left = smoothed.select("_series", F.abs(residual).alias("_left"))
        scales = exact_quantile(left, "_left", ["_series"], out="_scale", rows_per_bucket=rows_per_bucket)
        u = F.try_divide(F.abs(residual), OUTLIER_SCALE * F.col("_scale"))
        weight = F.when(u <= 0.001, 1.0).when(u <= 0.999, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        state = smoothed.join(cut_lineage(scales), "_series").withColumns({"_rho": weight, "_fits": F.col("_scale") <= 0}).drop("_scale")


def decompose(
    df: DataFrame,
    date_column: str,
    value_column: str,
    id_column: str,
    group_column: str | None = None,
    period: int | None = None,
    model: str = "additive",
    rows_per_bucket: int | None = None,
    piece: int = STL_PIECE,
) -> ProfileResult:
    """Trend, seasonal part and residual per series.

    Additive: robust loess decomposition. A series up to ``piece`` rows is one group; a
    longer one goes through its rounds in pieces, with the same values. Multiplicative:
    centred moving averages and mean ratios by phase. Series shorter than two periods stay
    NULL.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    if period is not None and period < 2:
        raise ValueError("a season has two or more steps")
    require_columns(df, columns=[date_column, value_column, id_column])
    placed, cuts = _numbered_rows(df, date_column, value_column, group_column, id_column, rows_per_bucket)
    sizes = placed.groupBy("_series").agg(F.count("*").alias("_n"), F.count("_y").alias("_known"))
    if period is None:
        inferred = infer_period(df, date_column, group_column).select(F.col("series").alias("_series"), F.col("period").alias("_period"))
        sizes = sizes.join(inferred, "_series")
    else:
        sizes = sizes.withColumn("_period", F.lit(period))
    fit = sizes.filter((F.col("_n") >= 2 * F.col("_period")) & (F.col("_known") > 0)).drop("_known")
    rows = cut_lineage(_neighbours(placed, cuts).withColumn("_f", _filled(True)).drop("_prev", "_next"))
    values = rows.select("_series", "_pos", "_f").join(fit, "_series")
    # one period given, or at most five inferred
    found = fit.agg(F.collect_set("_period").alias("periods"), F.coalesce(F.max("_n"), F.lit(0)).alias("longest")).first()
    periods, longest = sorted(found["periods"]), found["longest"]
    if model == "additive" or not periods:
        reach = stl_reach(max(periods, default=2))
        length = max(piece, reach)
        short = values.filter(F.col("_n") <= length)
        parts = short.groupBy("_series").applyInPandas(_decompose_whole, f"_series string, _pos long, {PARTS}")
        if longest > length:
            long = values.filter(F.col("_n") > length)
            parts = parts.unionByName(_decompose_rounds(long, length, reach, rows_per_bucket))
    else:
        parts = _classical(values, periods)
    out = rows.join(parts, ["_series", "_pos"], "left").select(*[quoted(c) for c in df.columns], "trend", "seasonal", "residual")
    metrics = out.agg(
        F.count("trend").alias("n_rows_decomposed"), F.count_if(F.col("trend").isNull()).alias("n_rows_skipped")
    )
    return ProfileResult(out, {"periods": sizes.select(F.col("_series").alias("series"), F.col("_period").alias("period"), F.col("_n").alias("n"))}, metrics)


def _classical(values: DataFrame, periods: list[int]) -> DataFrame:
    """Moving-average trend, mean ratio by phase scaled to one, remaining ratio.

    The moving average runs in pieces with half a period of overlap, so no window spans
    a whole series. There are at most five inferred periods.
    """
    trends = []
    for p in periods:
        half = p // 2
        pieces = _piece_rows(values.filter(F.col("_period") == p), max(STL_PIECE, 4 * p), half)
        inside = Window.partitionBy("_series", "_piece").orderBy("_pos")
        total = F.sum("_f").over(inside.rowsBetween(-half, half))
        if p % 2 == 0:
            total = total - (F.lag("_f", half).over(inside) + F.lead("_f", half).over(inside)) / 2
        complete = (F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half)
        averaged = pieces.withColumn("trend", F.when(complete, total / p))
        trends.append(averaged.filter("_core").select("_series", "_pos", "_f", F.pmod("_pos", F.lit(p)).alias("_phase"), "trend"))
    trended = union_all(trends)
    ratios = trended.groupBy("_series", "_phase").agg(F.avg(F.try_divide(F.col("_f"), F.col("trend"))).alias("_ratio"))
    levels = ratios.groupBy("_series").agg(F.avg("_ratio").alias("_level"))
    seasonal = ratios.join(levels, "_series").select("_series", "_phase", (F.col("_ratio") / F.col("_level")).alias("seasonal"))
    return trended.join(seasonal, ["_series", "_phase"]).select(
        "_series", "_pos", "trend", "seasonal", F.try_divide(F.col("_f"), F.col("trend") * F.col("seasonal")).alias("residual")
    )


# --- forecast ---------------------------------------------------------------------------


def _features(batch: pd.DataFrame) -> np.ndarray:
    return design(
        batch["t"].to_numpy(float), batch["days"].to_numpy(float), KNOTS, batch["yearly"].to_numpy(float), batch["weekly"].to_numpy(float)
    )


def _partial_sums(batches):
    """X'X, X'y and y'y per series, flattened (n rows per date weigh in).

    Rows come sorted by series, so sums of the series at hand go on into the next batch and a
    task writes one record per series.
    """
    at, total, rows = None, None, 0.0
    for batch in batches:
        x, y, w = _features(batch), batch["y"].to_numpy(float), batch["n"].to_numpy(float)
        z = np.column_stack([x, y])
        found = batch.groupby("series", sort=False).indices
        for key, idx in found.items():
            part = z[idx]
            sums = (part * w[idx, None]).T @ part
            # squares of y within a date come apart from the mean
            sums[-1, -1] += batch["within"].to_numpy(float)[idx].sum()
            if at is not None and key != at:
                yield pd.DataFrame({"series": [at], "n": [rows], "sums": [total.ravel()]})
                total, rows = None, 0.0
            at, total, rows = key, sums if total is None else total + sums, rows + float(w[idx].sum())
    if at is not None:
        yield pd.DataFrame({"series": [at], "n": [rows], "sums": [total.ravel()]})


def _solve(batches):
    for batch in batches:
        out = []
        for sums, n in zip(batch["sums"], batch["n"]):
            k = int(round(len(sums) ** 0.5)) - 1
            m = np.array(sums, dtype=float).reshape(k + 1, k + 1)
            xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
            penalty = np.full(k, RIDGE * max(n, 1.0))
            penalty[:2] = 1e-12
            penalty[2 : 2 + KNOTS] = 1e-4 * max(n, 1.0)
            beta = np.linalg.lstsq(xx + np.diag(penalty), xy, rcond=None)[0]
            error = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0) / max(n - 2, 1.0)
            out.append((beta, float(error**0.5), float(np.abs(beta[2 : 2 + KNOTS]).mean())))
        beta, sigma, bend = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"series": batch["series"], "beta": beta, "sigma": sigma, "bend": bend})


def _predict(batches):
    for batch in batches:
        x, beta = _features(batch), np.stack(batch["beta"].to_list())
        cut, waves = 2 + KNOTS, 2 + KNOTS + 20
        trend = (x[:, :cut] * beta[:, :cut]).sum(1)
        yearly = (x[:, cut:waves] * beta[:, cut:waves]).sum(1)
        weekly = (x[:, waves:] * beta[:, waves:]).sum(1)
        spread = _spread(batch["sigma"].to_numpy(float), batch["bend"].to_numpy(float), batch["t"].to_numpy(float))
        yield pd.DataFrame(
            {"series": batch["series"], "ds": batch["ds"], "fit": trend + yearly + weekly, "trend": trend, "yearly": yearly, "spread": spread, "is_forecast": batch["is_forecast"]}
        )


def _spread(sigma: np.ndarray, bend: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Deviation of the values around the forecast, the training time being 0 to 1.

    The trend goes on bending as often as there are hinges, by changes of slope whose mean
    size is that of the fitted ones (double exponential, variance twice its square). A change
    at s has moved the trend by its size times t - s: the sum has a variance with the cube of
    the time since the last date.
    """
    ahead = np.maximum(t - 1.0, 0.0)
    return np.sqrt(sigma**2 + KNOTS * 2.0 * bend**2 * ahead**3 / 3.0)


def forecast(
    df: DataFrame,
    date_column: str,
    value_column: str,
    group_column: str | None = None,
    forecast_periods: int = 12,
    seasonality_mode: str = "additive",
    include_history: bool = True,
) -> ProfileResult:
    """Trend with hinges plus yearly and weekly waves per series, with 80 % intervals.

    Intervals widen after the last date, since the trend may bend again. The table ``series``
    has the frequency and the first and last forecast date of every series.

    Rows of one date are folded to count, mean and spread before the fit; normal
    equations are summed over all tasks and solved per series. The multiplicative mode
    fits the logarithm of (positive) values.
    """
    if not 1 <= forecast_periods <= 1000:
        raise ValueError("forecast_periods must be between 1 and 1000")
    if seasonality_mode not in ("additive", "multiplicative"):
        raise ValueError("seasonality_mode must be 'additive' or 'multiplicative'")
    require_columns(df, date_column=date_column, value_column=value_column)
    log_scale = seasonality_mode == "multiplicative"
    raw = _series(df, date_column, value_column, group_column).filter("y is not null")
    if log_scale:
        raw = raw.filter("y > 0").withColumn("y", F.log("y"))
    train = cut_lineage(
        raw.groupBy("series", "ds").agg(
            F.count("*").alias("n"), F.avg("y").alias("y"), (F.var_pop("y") * F.count("*")).alias("within")
        )
    )
    spans = train.groupBy("series").agg(F.sum("n").alias("rows"), F.min("ds").alias("first"), F.max("ds").alias("last"), F.count("*").alias("dates"))
    spans = spans.filter("rows >= 10")
    days = (epoch_seconds(F.col("last")) - epoch_seconds(F.col("first"))) / DAY
    flags = spans.withColumns({"length": days, "gap": F.try_divide(days, F.col("dates") - 1)}).withColumns(
        {
            "yearly": (F.col("length") >= 730).cast("double"),
            "weekly": ((F.col("length") >= 14) & (F.col("gap") < 7)).cast("double"),
        }
    )
    future = future_dates(train, "ds", forecast_periods, "series").select("series", "ds")

    def placed(frame: DataFrame) -> DataFrame:
        since = (epoch_seconds(F.col("ds")) - epoch_seconds(F.col("first"))) / DAY
        return frame.join(flags, "series").withColumns(
            {
                "t": F.coalesce(F.try_divide(since, F.col("length")), F.lit(0.0)),
                "days": epoch_seconds(F.col("ds")) / DAY,
                "is_forecast": F.col("ds") > F.col("last"),
            }
        )

    columns = ["series", "t", "days", "yearly", "weekly"]
    ordered = placed(train).select(*columns, "y", "n", "within").sortWithinPartitions("series")
    partial = ordered.mapInPandas(_partial_sums, "series string, n double, sums array<double>")
    summed = partial.withColumn("v", array_to_vector("sums")).groupBy("series").agg(
        Summarizer.sum(F.col("v")).alias("v"), F.sum("n").alias("n")
    )
    model = cut_lineage(
        summed.select("series", "n", vector_to_array("v").alias("sums")).mapInPandas(_solve, "series string, beta array<double>, sigma double, bend double")
    )
    points = train.select("series", "ds").unionByName(future) if include_history else future
    scored = (
        placed(points)
        .join(model, "series")
        .select(*columns, "ds", "is_forecast", "beta", "sigma", "bend")
        .mapInPandas(_predict, "series string, ds timestamp_ntz, fit double, trend double, yearly double, spread double, is_forecast boolean")
    )
    back = F.exp if log_scale else (lambda c: c)
    rows = scored.select(
        "series",
        "ds",
        back(F.col("fit")).alias("yhat"),
        back(F.col("fit") - INTERVAL_Z * F.col("spread")).alias("yhat_lower"),
        back(F.col("fit") + INTERVAL_Z * F.col("spread")).alias("yhat_upper"),
        back(F.col("trend")).alias("trend"),
        "yearly",
        "is_forecast",
    )
    ends = future.groupBy("series").agg(F.min("ds").alias("forecast_start"), F.max("ds").alias("forecast_end"))
    frequency = infer_frequency(train, "ds", "series").select("series", "frequency")
    about = flags.select("series", F.col("rows").alias("training_rows"), F.col("last").alias("training_end"))
    about = about.join(frequency, "series", "left").join(ends, "series", "left")
    return ProfileResult(rows, {"series": about}, flags.agg(F.count("*").alias("n_series"), F.sum("rows").alias("training_rows")))
