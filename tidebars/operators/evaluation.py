"""Evaluation of features against forward labels: frames, screens, folds, out-of-fold ridge, gates, redundancy.

Rows are decision bars with features and the outcomes of every horizon. What grows with the bars is aggregated by Spark;
models need sums per fold only, and tables of cells, features or folds are as small as their number.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions.order import edges_of
from tidebars.functions.windows import corr, safe_div
from tidebars.operators.aggregates import average_rank, benjamini_hochberg
from tidebars.operators.labels import ahead, decisions, with_reason

c = F.col
#: Bars ahead of the horizons that an evaluation row needs, all of them.
HORIZONS = (2, 3, 4, 5, 6, 8)
#: Coefficients of the polynomial that gives the normal tail (Abramowitz and Stegun 26.2.17). Fixed values.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_STEP = 0.2316419


def with_outcomes(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Decision rows with reason_h and y_h (move over ATR20, NULL unless available) of every horizon: one sort for all."""
    rows = decisions(bars)
    for h in horizons:
        rows = with_reason(rows, h).withColumnRenamed("reason", f"reason_{h}")
        move = F.last("close").over(ahead(1, h)) - c("entry_price")
        rows = rows.withColumn(f"y_{h}", F.when(c(f"reason_{h}") == "available", safe_div(move, c("atr20"))))
    return rows


def evaluation_frame(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rows of Development and Validation sessions whose outcomes are all available and finite."""
    whole = reduce(lambda a, b: a & b, [(c(f"reason_{h}") == "available") & c(f"y_{h}").isNotNull() & ~F.isnan(f"y_{h}") for h in horizons])
    return rows.where(c("research_partition").isin("Development", "Validation") & c("entry_session").isNotNull() & whole)


def frame_funnel(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """step, rows left after each rule of the frame: one aggregate."""
    rules = [("all", F.lit(True)), ("partition", c("research_partition").isin("Development", "Validation")), ("session", c("entry_session").isNotNull())]
    rules += [(f"horizon_{h}", (c(f"reason_{h}") == "available") & c(f"y_{h}").isNotNull()) for h in horizons]
    held, counts = F.lit(True), []
    for name, rule in rules:
        held = held & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(held).alias(name))
    wide = rows.agg(*counts)
    return wide.select(F.posexplode(F.array(*[F.struct(F.lit(n).alias("rule"), c(n).alias("rows")) for n, _ in rules])).alias("step", "x")).select("step", "x.rule", "x.rows")


def normal_p(t: Column) -> Column:
    """Two-sided p-value of a normal statistic."""
    x = F.abs(t)
    k = 1 / (1 + TAIL_STEP * x)
    poly = F.lit(0.0)
    for a in reversed(TAIL):
        poly = (poly + F.lit(a)) * k
    return F.least(F.lit(1.0), 2 / math.sqrt(2 * math.pi) * F.exp(-x * x / 2) * poly)


def screen(rows: DataFrame, features: list[str], horizons: tuple[int, ...] = HORIZONS, least: int = 5) -> DataFrame:
    """Cells of feature, horizon, session and partition: dates, mean daily rank correlation, t, p, interval, q within the
    session, partition and horizon.

    Features are unpivoted, and a row's outcomes, a handful, ride along; ranks are within feature, session and date, so
    nothing is ordered as a whole.
    """
    keys = ["entry_session", "research_partition", "trade_date"]
    outcomes = [f"y_{h}" for h in horizons]
    long = rows.unpivot([*keys, *outcomes], features, "feature", "x").where("x IS NOT NULL")
    group = ["feature", *keys]
    long = long.withColumns({"rx": average_rank(c("x"), group), **{f"r_{h}": average_rank(c(f"y_{h}"), group) for h in horizons}})
    daily = long.groupBy(*group).agg(F.count("*").alias("n"), *[corr(c("rx"), c(f"r_{h}")).alias(f"ic_{h}") for h in horizons]).where(c("n") >= least)
    tall = daily.select(*group, F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), c(f"ic_{h}").alias("ic")) for h in horizons])).alias("e")).select(*group, "e.horizon", "e.ic").where("ic IS NOT NULL")
    cells = tall.groupBy("feature", "horizon", "entry_session", "research_partition").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"))
    error = F.when(c("sd") > 1e-9, c("sd") / F.sqrt("dates"))
    cells = cells.withColumns({"t": c("mean_ic") / error, "lo": c("mean_ic") - 1.96 * error, "hi": c("mean_ic") + 1.96 * error})
    # rounded before ranking, so that equal evidence ties
    cells = cells.withColumn("p", F.round(normal_p(c("t")), 9))
    return benjamini_hochberg(cells, "p", ["entry_session", "research_partition", "horizon"])


def residual_ic(rows: DataFrame, x: str, y: str, controls: list[str], day: str = "trade_date", least: int = 10) -> DataFrame:
    """trade_date, pairs, partial_ic: rank correlation of x and y given any number of controls.

    Each date's ranks give a small correlation matrix; the partial correlation follows from its inverse by removing one
    control after the other (the recursion on lower orders), all in columns.
    """
    names = [x, y, *controls]
    whole = reduce(lambda a, b: a & b, [c(n).isNotNull() for n in names])
    ranked = rows.where(whole).withColumns({f"r{i}": average_rank(c(n), [day]) for i, n in enumerate(names)})
    k = len(names)
    daily = ranked.groupBy(day).agg(F.count("*").alias("pairs"), *[corr(c(f"r{i}"), c(f"r{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i)]).where(c("pairs") >= least)
    last = k - 1
    while last >= 2:
        rho = lambda i, j: c(f"c{max(i, j)}_{min(i, j)}")
        step = {}
        for i in range(last):
            for j in range(i):
                rest = (1 - rho(i, last) * rho(i, last)) * (1 - rho(j, last) * rho(j, last))
                step[f"c{i}_{j}"] = F.when(rest > 1e-12, (rho(i, j) - rho(i, last) * rho(j, last)) / F.sqrt(rest))
        daily = daily.select(day, "pairs", *[v.alias(n) for n, v in step.items()])
        last -= 1
    return daily.withColumnRenamed("c1_0", "partial_ic")


def fold_table(spark, dates: int, first: int, size: int, folds: int) -> DataFrame:
    """fold, train_to, assess_from, assess_to over date numbers from 0: expanding training, one date left out between."""
    rows = [(i, first + i * size - 2, first + i * size, min(first + (i + 1) * size - 1, dates - 1)) for i in range(folds) if first + i * size < dates]
    return spark.createDataFrame(rows, "fold int, train_to int, assess_from int, assess_to int")


def by_fold(rows: DataFrame, dates: DataFrame, folds: DataFrame) -> DataFrame:
    """rows once per fold and role (train, assess); dates: trade_date, no. Folds are a handful of rows."""
    numbered = rows.join(dates, "trade_date").join(F.broadcast(folds), (c("no") <= c("train_to")) | c("no").between(c("assess_from"), c("assess_to")))
    return numbered.withColumn("role", F.when(c("no") <= c("train_to"), "train").otherwise("assess"))


def ridge_sums(rows: DataFrame, x: list[str], y: str, keys: list[str]) -> DataFrame:
    """keys, n, means, deviations and standardised moments of two features and an outcome: what a ridge needs."""
    a, b = x
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("cab"), F.covar_pop(a, y).alias("cay"), F.covar_pop(b, y).alias("cby")
    )
    return sums.withColumns({"rab": safe_div(c("cab"), c("sa") * c("sb")), "ray": safe_div(c("cay"), c("sa")), "rby": safe_div(c("cby"), c("sb"))})


def ridge_coefficients(sums: DataFrame, penalty: Column) -> DataFrame:
    """sums with ba, bb: coefficients on standardised features, penalty per observation."""
    d = (1 + penalty) * (1 + penalty) - c("rab") * c("rab")
    return sums.withColumns({"ba": safe_div((1 + penalty) * c("ray") - c("rab") * c("rby"), d), "bb": safe_div((1 + penalty) * c("rby") - c("rab") * c("ray"), d)})


def predicted(x: list[str]) -> Column:
    return c("my") + c("ba") * safe_div(c(x[0]) - c("ma"), c("sa")) + c("bb") * safe_div(c(x[1]) - c("mb"), c("sb"))


def walk_forward(rows: DataFrame, dates: DataFrame, folds: DataFrame, x: list[str], y: str, penalties: list[float]) -> DataFrame:
    """fold, penalty, trade_date, bar_id, y, prediction: out of fold, each penalty fitted on the fold's training dates."""
    both = by_fold(rows, dates, folds)
    sums = ridge_sums(both.where("role = 'train'"), x, y, ["fold"]).withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))
    fits = ridge_coefficients(sums, c("penalty")).select("fold", "penalty", "ma", "mb", "my", "sa", "sb", "ba", "bb")
    # folds times penalties: a few rows
    scored = both.where("role = 'assess'").join(F.broadcast(fits), "fold")
    return scored.select("fold", "penalty", "trade_date", "bar_id", c(y).alias("y"), predicted(x).alias("prediction"))


def choose_penalty(scored: DataFrame) -> DataFrame:
    """penalty, mean_ic, chosen: the best mean correlation over folds; ties go to the larger penalty."""
    folds = scored.groupBy("fold", "penalty").agg(F.round(corr(c("prediction"), c("y")), 9).alias("ic"))
    table = folds.groupBy("penalty").agg(F.round(F.avg("ic"), 9).alias("mean_ic"))
    best = table.agg(F.max_by("penalty", F.struct("mean_ic", "penalty")).alias("best"))
    return table.join(F.broadcast(best)).select("penalty", "mean_ic", (c("penalty") == c("best")).alias("chosen"))


def refit(rows: DataFrame, x: list[str], y: str, penalty: float) -> DataFrame:
    """Validation rows with the prediction of a ridge fitted on all Development rows."""
    fit = ridge_coefficients(ridge_sums(rows.where("research_partition = 'Development'"), x, y, []), F.lit(penalty))
    return rows.where("research_partition = 'Validation'").join(F.broadcast(fit.select("ma", "mb", "my", "sa", "sb", "ba", "bb"))).withColumn("prediction", predicted(x))


def correlations(rows: DataFrame, features: list[str]) -> DataFrame:
    """a, b, rho of every pair of features (a before b by name): rank correlation over whole rows, ranks within dates, in
    one aggregate."""
    names = sorted(features)
    ranked = rows.where(reduce(lambda p, q: p & q, [c(n).isNotNull() for n in names])).withColumns({f"k_{n}": average_rank(c(n), ["trade_date"]) / F.count("*").over(Window.partitionBy("trade_date")) for n in names})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = ranked.agg(*[corr(c(f"k_{a}"), c(f"k_{b}")).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("x")).select("x.*")


def clusters(pairs: DataFrame, features: list[str], threshold: float) -> dict[str, str]:
    """The first name of each feature's group of features linked by |rho| at or above the threshold; features x features rows."""
    leader = {f: f for f in features}
    for a, b in sorted((r["a"], r["b"]) for r in pairs.where(F.abs("rho") >= threshold).collect()):
        x, y = sorted((leader[a], leader[b]))
        leader = {f: x if g == y else g for f, g in leader.items()}
    return leader


def daily_scores(rows: DataFrame, features: list[str], y: str, least: int = 10) -> DataFrame:
    """feature, score: the size of the mean daily rank correlation with y, all features in one grouped plan."""
    group = ["feature", "trade_date"]
    long = rows.select("trade_date", y, *[c(n).cast("double").alias(n) for n in features]).unpivot(["trade_date", y], features, "feature", "x")
    long = long.withColumns({"rx": average_rank(c("x"), group), "ry": average_rank(c(y), group)})
    daily = long.groupBy(*group).agg(F.count("*").alias("n"), corr(c("rx"), c("ry")).alias("rho")).where((c("n") >= least) & c("rho").isNotNull())
    return daily.groupBy("feature").agg(F.round(F.abs(F.avg("rho")), 9).alias("score"))


def partial_scores(rows: DataFrame, features: list[str], y: str, control: str, least: int = 10) -> DataFrame:
    """feature, partial: mean daily rank correlation with y given the control, all features in one grouped plan."""
    group = ["feature", "trade_date"]
    long = rows.select("trade_date", y, c(control).alias("z"), *[c(n).cast("double").alias(n) for n in features]).unpivot(["trade_date", y, "z"], features, "feature", "x")
    long = long.withColumns({"rx": average_rank(c("x"), group), "ry": average_rank(c(y), group), "rz": average_rank(c("z"), group)})
    daily = long.groupBy(*group).agg(F.count("*").alias("n"), corr(c("rx"), c("ry")).alias("xy"), corr(c("rx"), c("rz")).alias("xz"), corr(c("ry"), c("rz")).alias("yz")).where(c("n") >= least)
    rest = (1 - c("xz") * c("xz")) * (1 - c("yz") * c("yz"))
    return daily.withColumn("p", F.when(rest > 1e-12, (c("xy") - c("xz") * c("yz")) / F.sqrt(rest))).groupBy("feature").agg(F.round(F.avg("p"), 6).alias("partial"))


def representatives(scores: DataFrame) -> DataFrame:
    """The best feature of each cluster: highest score, core before experimental, then name; scores: cluster, feature, score,
    experimental."""
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "experimental", "feature")
    return scores.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def failed_gates(gates: dict[str, Column]) -> Column:
    """The names of the gates that don't hold, in order; a gate without a value fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))


def deciles(rows: DataFrame, x: str, n: int = 10) -> DataFrame:
    """decile (1 to n) by the Development quantiles of x; a value on an edge belongs below it, as equal values do together."""
    edges = edges_of(rows.where("research_partition = 'Development'"), x, [i / n for i in range(1, n)])
    return rows.join(F.broadcast(edges)).withColumn("decile", F.when(c(x).isNotNull(), 1 + F.size(F.filter("edges", lambda e: e < c(x))))).drop("edges")


def nested_expansion(rows: DataFrame, dates: DataFrame, folds: DataFrame, x: str, q: float) -> DataFrame:
    """fold, threshold (from the fold's training dates alone), rows and share of assessment rows that reach it."""
    both = by_fold(rows.where(c(x).isNotNull()), dates, folds)
    edges = both.where("role = 'train'").groupBy("fold").agg(F.percentile(x, F.lit(q)).alias("threshold"))
    held = both.where("role = 'assess'").join(F.broadcast(edges), "fold")
    return held.groupBy("fold", "threshold").agg(F.count("*").alias("rows"), F.avg((c(x) >= c("threshold")).cast("double")).alias("share"))


def spread_sharpe(rows: DataFrame, x: str, y: str, n: int = 5, least: int = 2, periods: float = 252.0) -> DataFrame:
    """Per partition: annualised Sharpe ratio of the daily difference between the outer buckets of x (Development edges)."""
    edges = edges_of(rows.where("research_partition = 'Development'"), x, [1 / n, 1 - 1 / n])
    sides = rows.where(c(x).isNotNull() & c(y).isNotNull()).join(F.broadcast(edges))
    low, high = c(x) <= F.get("edges", F.lit(0)), c(x) > F.get("edges", F.lit(1))
    daily = sides.groupBy("research_partition", "trade_date").agg(F.avg(F.when(high, c(y))).alias("top"), F.avg(F.when(low, c(y))).alias("bottom"), F.count_if(high).alias("n_top"), F.count_if(low).alias("n_bottom"))
    daily = daily.where((c("n_top") >= least) & (c("n_bottom") >= least)).withColumn("spread", c("top") - c("bottom"))
    return daily.groupBy("research_partition").agg(F.count("*").alias("days"), F.avg("spread").alias("mean_spread"), (safe_div(F.avg("spread"), F.stddev_samp("spread")) * math.sqrt(periods)).alias("sharpe"))


def overlap_audit(rows: DataFrame, new: list[str], old: list[str], near: float = 0.98) -> DataFrame:
    """feature, existing, n, rho, equal (rows with the same value), near_duplicate of every pair: one aggregate."""
    pairs = [(a, b) for a in new for b in old]
    both = lambda a, b: c(a).isNotNull() & c(b).isNotNull()
    wide = rows.agg(*[F.struct(F.count_if(both(a, b)).alias("n"), corr(c(a), c(b)).alias("rho"), F.count_if(both(a, b) & (c(a) == c(b))).alias("equal")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    out = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature"), F.lit(b).alias("existing"), c(f"p{i}.n").alias("n"), c(f"p{i}.rho").alias("rho"), c(f"p{i}.equal").alias("equal")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return out.withColumn("near_duplicate", F.coalesce((F.abs("rho") >= near) | (c("equal") == c("n")), F.lit(False)))
