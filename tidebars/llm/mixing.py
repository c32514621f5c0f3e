"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells (source, language, topic). Token weights of the cells are raked in turn to the three
target marginals; a cell's fitted weight over its own weight, over the largest such ratio, is the probability of
its documents. In expectation the sample has the target shares.

Targets are given per dimension as a mapping of categories to weights, or are the categories' shares to the power alpha.
Categories that a mapping doesn't name have together what it gives "*", else the share they have anyway, split by the same
power. A named category that the corpus lacks can't be met: fit() raises, or with strict=False spreads its share.
Every category has its own target; marginals are tables keyed by category, and cells are raked by source where they
lie and by language and topic in their table of sums, so no step needs all cells in one place.

Where a target asks for much more of a small category than there is, all others would be thinned out to match. clip names
a share of all tokens: the cells of the highest ratios that hold no more than that are kept whole instead, and the rest is
scaled by the next ratio. marginal_error, the largest difference of a fitted share from its target, tells how far the rounds
have come; they end at `rounds`, or earlier once no step changes a cell by more than `tolerance`.

Defined results: a null source or language is the category ""; the topic is the column of that name if there is one (null:
""), else licence, note, article or book by a word of licences and the length; a null or empty text weighs one token;
whether a document is sampled depends on doc_id and the seed alone (a null doc_id counts as ""), so repeated rows go
together; an empty table gives no rows; other columns are kept, whatever their names, but for those that have the name of a
column that mix() adds; sampled() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.quality import words
from tidebars.llm.store import aside, materialize, restored

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, ALPHA, SEED = 8, 0.7, "mix-1"
#: Ratios of cells fall into so many classes a factor of two when the cells to be kept whole are looked for.
CLASSES = 8
#: Keys over which the rows of one cell are dealt.
SALTS = 16
_HEX = 12
OWN = ("doc_id", "text", "lang", "source", "topic")
ADDED = ("tokens", "topic", "probability", "marginal_error", "sampled")


def default_topic(text: Column, tokens: Column) -> Column:
    return F.when(F.contains(F.translate(text, "LICENS", "licens"), F.lit("licens")), "licence").when(tokens < 150, "note").when(tokens < 1500, "article").otherwise("book")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only doc_id and the seed decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def cells_of(docs: DataFrame) -> DataFrame:
    """aside(docs, OWN) with tokens and the categories g_source, g_lang, g_topic."""
    rows = aside(docs, OWN)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumn("tokens", F.greatest(F.lit(1), F.size(words(text))).cast("long"))
    has_topic = any(c.lower() == "topic" for c in docs.columns)
    topic = F.col("topic").cast("string") if has_topic else default_topic(text, F.col("tokens"))
    return rows.withColumns({"g_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "g_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "g_topic": F.coalesce(topic, F.lit(""))})


def _marginal(cells: DataFrame, d: str, alpha: float, given: dict[str, float] | None, strict: bool) -> DataFrame:
    """g_d, t_d: the target of each category of a dimension; they sum to one."""
    own = cells.groupBy(f"g_{d}").agg(F.sum("tokens").cast("double").alias("own")).withColumn("t", F.pow("own", F.lit(alpha)))
    if given:
        spark = cells.sparkSession
        named = spark.createDataFrame([(k, float(v)) for k, v in given.items() if k != "*"], f"g_{d} string, weight double")
        if strict and (missing := [r[0] for r in named.where("weight > 0").join(own, f"g_{d}", "left_anti").collect()]):
            raise ValueError(f"no document for the targets of {d}: {', '.join(sorted(missing))}")
        own = own.join(named, f"g_{d}", "left")
        free = F.sum(F.when(F.col("weight").isNull(), F.col("own"))) / F.sum("own")
        # without any named category the others have it all
        rest = F.lit(float(given["*"])) if "*" in given else F.coalesce(F.sum("weight") * F.try_divide(free, 1 - free), F.lit(1.0))
        sums = own.agg(F.coalesce(rest, F.lit(0.0)).alias("rest"), F.sum(F.when(F.col("weight").isNull(), F.col("t"))).alias("free_t"))
        own = own.join(F.broadcast(sums)).withColumn("t", F.coalesce("weight", F.try_divide(F.col("rest") * F.col("t"), F.col("free_t")), F.lit(0.0)))
    own = materialize(own.select(f"g_{d}", "t"), f"targets-{d}")
    # one row, the sum of all
    return own.join(F.broadcast(own.agg(F.sum("t").alias("all_t")))).select(f"g_{d}", F.coalesce(F.try_divide("t", "all_t"), F.lit(0.0)).alias(f"t_{d}"))


def fit(cells: DataFrame, rounds: int = ROUNDS, alpha: float = ALPHA, targets: dict[str, dict[str, float]] | None = None, strict: bool = True, clip: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """g_source, g_lang, g_topic, probability, marginal_error from the same with tokens.

    A cell's weight is own * f(lang, topic) times what the source's target asks for, so between rounds only the table
    of f is kept.
    """
    keys = [f"g_{d}" for d in DIMENSIONS]
    cells = materialize(cells.select(*keys, F.col("tokens").cast("double").alias("own"), "tokens"), "cells")
    pooled = cells.drop("tokens")
    for d in DIMENSIONS:
        pooled = pooled.join(_marginal(cells, d, alpha, (targets or {}).get(d), strict), f"g_{d}")
    pooled = materialize(pooled, "cells")
    pair = ["g_lang", "g_topic"]

    def by_source(f: DataFrame) -> DataFrame:
        w = pooled.join(f, pair).withColumn("w", F.col("own") * F.col("f"))
        total = F.sum("w").over(Window.partitionBy("g_source"))
        return w.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col("t_source"), total), F.lit(0.0)))

    sums = pooled.select(*pair, "t_lang", "t_topic").distinct().withColumns({"f": F.lit(1.0), "ratio": F.lit(1.0)})
    factors = last = materialize(sums.select(*pair, "f", "ratio"), "factors")
    for _ in range(rounds):
        sums = by_source(factors.select(*pair, "f")).groupBy(*pair).agg(F.sum("w").alias("w"), F.first("f").alias("f"), F.first("t_lang").alias("t_lang"), F.first("t_topic").alias("t_topic"))
        sums = _factor(_factor(sums.withColumn("ratio", F.lit(1.0)), "lang"), "topic")
        last, factors = factors, materialize(sums.select(*pair, (F.col("f") * F.col("ratio")).alias("f"), "ratio"), "factors")
        if tolerance:
            step = factors.agg(F.max(F.abs(F.when(F.col("ratio") > 0, F.col("ratio") - 1)))).first()[0]
            if step is None or step <= tolerance:
                break
    if rounds:
        fitted = by_source(last.select(*pair, "f")).drop("f").join(factors.select(*pair, "ratio"), pair)
        fitted = fitted.withColumn("w", F.col("w") * F.col("ratio"))
    else:
        fitted = pooled.withColumn("w", F.col("own"))
    fitted = materialize(fitted.select(*keys, "own", "w", *[f"t_{d}" for d in DIMENSIONS], (F.col("w") / F.col("own")).alias("ratio")), "fitted")
    # one row each: the ratio that stands for certainty, and the largest error of a marginal
    classes = fitted.where("ratio > 0").groupBy(F.floor(F.log2("ratio") * CLASSES).alias("class")).agg(F.sum("own").alias("own"), F.max("ratio").alias("most"))
    # a few hundred classes at most: as many as doubles have powers of two, times CLASSES
    held = F.sum("own").over(Window.orderBy(F.desc("class"))) / F.sum("own").over(Window.partitionBy())
    top = classes.withColumn("held", held).where(F.col("held") > clip).agg(F.max("most").alias("most"))
    errors = [fitted.groupBy(f"g_{d}").agg(F.abs(F.sum("w") - F.first(f"t_{d}")).alias("e")).agg(F.max("e").alias(f"e_{d}")) for d in DIMENSIONS]
    one = top
    for e in errors:
        one = one.join(e)
    one = materialize(one.select("most", F.greatest(*[f"e_{d}" for d in DIMENSIONS]).alias("marginal_error")), "scale")
    chance = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("ratio"), F.col("most")), F.lit(0.0)))
    return fitted.join(F.broadcast(one)).select(*keys, F.round(chance, 9).alias("probability"), "marginal_error")


def _factor(sums: DataFrame, d: str) -> DataFrame:
    """w of (lang, topic) raked to a dimension's targets, ratio carrying what that multiplies the cells by."""
    total = F.sum("w").over(Window.partitionBy(f"g_{d}"))
    step = F.coalesce(F.try_divide(F.col(f"t_{d}"), total), F.lit(0.0))
    return sums.withColumn("step", step).withColumns({"w": F.col("w") * F.col("step"), "ratio": F.col("ratio") * F.col("step")}).drop("step")


def _drawn(docs: DataFrame, seed: str, **options) -> DataFrame:
    """cells_of(docs) with probability, marginal_error, sampled."""
    rows = cells_of(docs)
    keys = [f"g_{d}" for d in DIMENSIONS]
    table = materialize(fit(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), **options), "mixture")
    # the rows of a large cell are dealt to SALTS keys, to each of which the cell's row is sent
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(table, [*keys, "salt"])
    return rows.withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("probability"))


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Every row of docs with tokens, topic, probability, marginal_error and sampled (whether the draw takes it); options: of fit()."""
    return restored(_drawn(docs, seed, **options).withColumn("topic", F.col("g_topic")), docs, OWN, ADDED)


def sampled(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The rows of docs that the draw takes, with the columns of docs as they are."""
    rows = _drawn(docs, seed, **options).where("sampled")
    return restored(rows, docs, OWN)


def report(docs: DataFrame, **options) -> DataFrame:
    out = mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source"), **options)
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), F.round("marginal_error", 6).alias("marginal_error"), "sampled")
