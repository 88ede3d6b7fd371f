"""Logistic regression of a condition on one variable, for all configurations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.operators.joins import join
from riffle.session import BROADCAST_ROWS, materialize

STEPS = 80


def fit_logistic(frame: DataFrame, keys: Sequence[str], steps: int = STEPS, tolerance: float = 1e-9) -> DataFrame:
    """Newton's method on x scaled to zero mean and unit spread.

    ``frame`` has the key columns, ``x`` and ``y`` in {0, 1}. Each step is one aggregate of six
    sums per configuration; the 2 x 2 system is solved in columns. A step that raises the deviance
    is halved. A configuration that cannot be fitted gets a status and NULL coefficients instead
    of an error; ``separated`` is decided exactly, from the ranges of x in the two classes. ``n``
    is the true number of observations.
    """
    y = F.col("y").cast("double")
    base = frame.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("x_mean"), F.stddev_pop("x").alias("x_sd"), F.sum(y).alias("ones"),
        F.min(F.when(y == 1, F.col("x"))).alias("one_low"), F.max(F.when(y == 1, F.col("x"))).alias("one_high"),
        F.min(F.when(y == 0, F.col("x"))).alias("zero_low"), F.max(F.when(y == 0, F.col("x"))).alias("zero_high"))
    apart = (F.col("zero_high") <= F.col("one_low")) | (F.col("one_high") <= F.col("zero_low"))
    status = (
        F.when(F.col("n") < 3, "too_few_rows").when((F.col("ones") == 0) | (F.col("ones") == F.col("n")), "one_class")
        .when(~(F.col("x_sd") > 0), "constant_x").when(apart, "separated").otherwise("ok")
    )
    base = materialize(base.withColumn("status", status).drop("one_low", "one_high", "zero_low", "zero_high"), "logistic")
    count = base.count()
    nothing = F.lit(None).cast("double")
    active = base.filter(F.col("status") == "ok").withColumns({
        "a": F.lit(0.0), "b": F.lit(0.0), "from_a": F.lit(0.0), "from_b": F.lit(0.0), "deviance": nothing, "b_se": nothing, "moved": F.lit(float("inf"))})
    parts = [base.filter(F.col("status") != "ok")]
    for _ in range(steps + 1):
        current = active.select(*keys, "x_mean", "x_sd", "a", "b")
        rows = join(frame, F.broadcast(current) if count <= BROADCAST_ROWS else current, keys)
        z = (F.col("x") - F.col("x_mean")) / F.col("x_sd")
        rows = rows.withColumn("z_", z).withColumn("eta_", F.col("a") + F.col("b") * F.col("z_")).withColumn(
            "p_", 1 / (1 + F.exp(-F.col("eta_"))))
        w, gap, eta = F.col("p_") * (1 - F.col("p_")), y - F.col("p_"), F.col("eta_")
        sums = rows.groupBy(*keys).agg(
            F.sum(w).alias("w_"), F.sum(w * F.col("z_")).alias("wz_"), F.sum(w * F.col("z_") * F.col("z_")).alias("wzz_"),
            F.sum(gap).alias("g_"), F.sum(gap * F.col("z_")).alias("gz_"),
            F.sum(2 * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) - y * eta)).alias("loss"),
        )
        det = F.nullif(F.col("w_") * F.col("wzz_") - F.col("wz_") * F.col("wz_"), F.lit(0.0))
        step_a = (F.col("wzz_") * F.col("g_") - F.col("wz_") * F.col("gz_")) / det
        step_b = (F.col("w_") * F.col("gz_") - F.col("wz_") * F.col("g_")) / det
        # Deviance and standard error belong to the coefficients before the step. Where the last step has raised the
        # deviance, the next point is half-way back to the one it came from, which stays the best so far.
        worse = F.coalesce(F.col("loss") > F.col("deviance") + 1e-9 * (1 + F.abs("deviance")), F.lit(False)) | F.isnan("loss") | F.isnan("da")
        moved = join(active, sums, keys).withColumns({"da": step_a, "db": step_b}).withColumn("worse", worse).select(
            *[c for c in active.columns if c not in ("a", "b", "from_a", "from_b", "deviance", "b_se", "moved", "status")],
            *[F.when(F.col("worse"), (F.col(c) + F.col(f"from_{c}")) / 2).otherwise(F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in "ab"],
            *[F.when(F.col("worse"), F.col(f"from_{c}")).otherwise(F.col(c)).alias(f"from_{c}") for c in "ab"],
            F.when(F.col("worse"), F.col("deviance")).otherwise(F.col("loss")).alias("deviance"),
            F.when(F.col("worse"), F.col("b_se")).otherwise(F.sqrt(F.col("w_") / det)).alias("b_se"),
            F.when(F.col("worse"), F.abs(F.col("a") - F.col("from_a")) + F.abs(F.col("b") - F.col("from_b"))).otherwise(
                F.coalesce(F.abs("da") + F.abs("db"), F.lit(float("inf")))).alias("moved"), "status")
        solved = materialize(moved.select(*active.columns), "logistic")
        over = F.col("moved") < tolerance
        parts.append(solved.filter(over))
        active = solved.filter(~over)
        if active.isEmpty():
            break
    else:
        parts.append(active.withColumn("status", F.lit("no_convergence")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    good = F.col("status") == "ok"
    return materialize(result.withColumns({
        "slope": F.when(good, F.col("b") / F.col("x_sd")),
        "intercept": F.when(good, F.col("a") - F.col("b") * F.col("x_mean") / F.col("x_sd")),
        "slope_se": F.when(good, F.col("b_se") / F.col("x_sd")),
        "deviance": F.when(good, F.col("deviance")),
    }).drop("a", "b", "from_a", "from_b", "b_se", "moved"), "logistic")


# Rational approximation of the complementary error function, relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    polynomial = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        polynomial = polynomial * t + c
    return t * F.exp(polynomial - x * x)


def summarize_logistic(models: DataFrame) -> DataFrame:
    """AIC, p-value of the slope and McFadden R2; NULL where the fit failed."""
    n, ones = F.col("n").cast("double"), F.col("ones")
    rate = ones / n
    inside = (ones > 0) & (ones < n)
    null = F.when(inside, -2 * (ones * F.log(rate) + (n - ones) * F.log(1 - rate)))
    return models.withColumns({
        "AIC": F.col("deviance") + 4,
        "PValue": normal_tail(F.when(F.col("slope_se") > 0, F.col("slope") / F.col("slope_se"))),
        "McFaddensR2": 1 - F.col("deviance") / null,
    })


def predict_logistic(models: DataFrame, frame: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Fitted probability of every observation; configurations without observations or fit stay.

    ``rows`` is the number of models.
    """
    eta = F.col("intercept") + F.col("slope") * F.col("x")
    kept = models.select(*keys, "status", "intercept", "slope")
    fitted = join(frame, F.broadcast(kept) if rows <= BROADCAST_ROWS else kept, keys)
    good = fitted.filter(F.col("slope").isNotNull()).withColumn("predictedVals", 1 / (1 + F.exp(-eta)))
    failed = kept.filter(F.col("slope").isNull())
    return good.drop("intercept", "slope").unionByName(failed.drop("intercept", "slope"), allowMissingColumns=True)
