"""A/B readout and two-proportion statistics as column expressions.

Everything is computed per segment with ``groupBy`` + column arithmetic, so
the test is a distributed computation that also works for thousands of
segments; no row is collected to the driver. The only driver-side number is
the critical value, computed once from alpha.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import pct
from ..functions.normal import cdf, two_sided_p
from .flags import segment_user_counts, stage_flags


def z_critical(alpha: float) -> float:
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def ab_readout(
    users: DataFrame,
    events: DataFrame,
    activation_event: str = K.ACTIVATION_EVENT,
    segments: Sequence[str] = (),
) -> DataFrame:
    """[segments...], experiment_group, users_in_group, activated_users, activation_rate_pct."""
    flags = stage_flags(events, [("activated", activation_event)])
    counts = segment_user_counts(users, flags, [*segments, "experiment_group"], ["activated"])
    return readout_table(counts, segments)


def readout_table(counts: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """From (segments..., experiment_group, users, activated) counts."""
    return counts.select(
        *segments,
        "experiment_group",
        F.col("users").alias("users_in_group"),
        F.col("activated").alias("activated_users"),
        pct("activated", "users", 2).alias("activation_rate_pct"),
    )


def align_arms(
    readout: DataFrame,
    control: str = K.ARM_CONTROL,
    treatment: str = K.ARM_TREATMENT,
    segments: Sequence[str] = (),
) -> DataFrame:
    """Control and treatment counts side by side, one row per segment (no self join)."""
    grp = F.col("experiment_group")

    def pick(arm: str, c: str) -> Column:
        return F.max(F.when(grp == arm, F.col(c)))

    return readout.groupBy(*segments).agg(
        pick(control, "users_in_group").cast("bigint").alias("n_control"),
        pick(treatment, "users_in_group").cast("bigint").alias("n_treatment"),
        pick(control, "activated_users").cast("bigint").alias("x_control"),
        pick(treatment, "activated_users").cast("bigint").alias("x_treatment"),
    )


def two_proportion_stats(aligned: DataFrame, alpha: float = K.ALPHA, segments: Sequence[str] = ()) -> DataFrame:
    """Unrounded z-test (pooled SE), CI (unpooled SE), lifts, Cohen's h, decision.

    Zero standard errors give NULL z / p (not an error).
    """
    n1, n2 = F.col("n_control").cast("double"), F.col("n_treatment").cast("double")
    x1, x2 = F.col("x_control").cast("double"), F.col("x_treatment").cast("double")
    p1 = x1 / F.nullif(n1, F.lit(0.0))
    p2 = x2 / F.nullif(n2, F.lit(0.0))
    lift = p2 - p1
    p_pool = (x1 + x2) / F.nullif(n1 + n2, F.lit(0.0))
    m1, m2 = F.nullif(n1, F.lit(0.0)), F.nullif(n2, F.lit(0.0))  # an arm without users gives NULL
    se_pool = F.sqrt(p_pool * (F.lit(1.0) - p_pool) * (F.lit(1.0) / m1 + F.lit(1.0) / m2))
    z = (p2 - p1) / F.nullif(se_pool, F.lit(0.0))
    se_unpooled = F.sqrt((p1 * (F.lit(1.0) - p1) / m1) + (p2 * (F.lit(1.0) - p2) / m2))
    zc = F.lit(z_critical(alpha))
    h = F.abs(F.lit(2.0) * F.asin(F.sqrt(p2)) - F.lit(2.0) * F.asin(F.sqrt(p1)))
    stats = aligned.select(
        *segments, "n_control", "n_treatment", "x_control", "x_treatment",
        p1.alias("p_control"),
        p2.alias("p_treatment"),
        (lift * F.lit(100.0)).alias("abs_lift_pp"),
        F.when(p1 > 0, lift / p1 * F.lit(100.0)).otherwise(F.lit(0.0)).alias("rel_lift_pct"),
        z.alias("z_stat"),
        ((lift - zc * se_unpooled) * F.lit(100.0)).alias("ci_lower_pp"),
        ((lift + zc * se_unpooled) * F.lit(100.0)).alias("ci_upper_pp"),
        h.alias("cohens_h"),
    )
    return stats.withColumn("p_value", two_sided_p(F.col("z_stat"))).withColumn(
        "is_significant", F.col("p_value") < F.lit(alpha)
    )


PUBLISHED_DIGITS = (
    ("p_control", 2, 100.0), ("p_treatment", 2, 100.0), ("abs_lift_pp", 2, 1.0), ("rel_lift_pct", 2, 1.0),
    ("ci_lower_pp", 2, 1.0), ("ci_upper_pp", 2, 1.0), ("z_stat", 3, 1.0), ("p_value", 5, 1.0), ("cohens_h", 4, 1.0),
)


def publish(stats: DataFrame, segments: Sequence[str] = ()) -> DataFrame:
    """Rounded publication row: rates in %, lifts/CI 2 dp, z 3, p 5, h 4."""
    rounded = [F.round(F.col(c) * F.lit(scale), d).alias(c) for c, d, scale in PUBLISHED_DIGITS]
    return stats.select(*segments, "n_control", "n_treatment", "x_control", "x_treatment", *rounded, "is_significant")


def ab_ztest(
    users: DataFrame, events: DataFrame, alpha: float = K.ALPHA, segments: Sequence[str] = (),
    activation_event: str = K.ACTIVATION_EVENT,
) -> DataFrame:
    readout = ab_readout(users, events, activation_event, segments)
    return publish(two_proportion_stats(align_arms(readout, segments=segments), alpha, segments), segments)


def power_column(h: Column, n1: Column, n2: Column, alpha: float) -> Column:
    """Power of the two-sided test: Phi(|h| * sqrt(1 / (1/n1 + 1/n2)) - z_crit)."""
    n1, n2 = (F.nullif(n.cast("double"), F.lit(0.0)) for n in (n1, n2))
    arg = F.abs(h) * F.sqrt(F.lit(1.0) / (F.lit(1.0) / n1 + F.lit(1.0) / n2)) - F.lit(z_critical(alpha))
    return cdf(arg)


def ab_power(users: DataFrame, events: DataFrame, alpha: float = K.ALPHA) -> DataFrame:
    stats = two_proportion_stats(align_arms(ab_readout(users, events)), alpha)
    return stats.select(
        "n_control", "n_treatment",
        F.round("cohens_h", 4).alias("cohens_h"),
        F.lit(alpha).alias("alpha"),
        F.round(power_column(F.col("cohens_h"), F.col("n_control"), F.col("n_treatment"), alpha), 4).alias("power"),
    )


def whatif_z(p1: Column, p2: Column, n_per_arm) -> Column:
    """Pooled z for two equal arms of ``n_per_arm`` users (a number or a column) with rates p1, p2."""
    n = n_per_arm.cast("double") if isinstance(n_per_arm, Column) else F.lit(float(n_per_arm))
    p_pool = (p1 + p2) / F.lit(2.0)
    se = F.sqrt(p_pool * (F.lit(1.0) - p_pool) * (F.lit(2.0) / n))
    return (p2 - p1) / F.nullif(se, F.lit(0.0))


def ab_whatif(
    users: DataFrame, events: DataFrame, segment: str = "channel",
    n_per_arm: int | Sequence[int] = K.WHATIF_N_PER_ARM, alpha: float = K.ALPHA,
) -> DataFrame:
    """Significance calculator applied to each segment's observed arm rates.

    For every segment (and every per-arm sample size when ``n_per_arm`` is a
    list): the observed control / treatment activation rates, and the z,
    two-sided p and decision the test would give with that many users per arm.
    Several sizes are expanded with a generator (``explode``), not a join.
    """
    sizes = [n_per_arm] if isinstance(n_per_arm, int) else list(n_per_arm)
    aligned = align_arms(ab_readout(users, events, segments=[segment]), segments=[segment])
    p1 = F.col("x_control") / F.nullif(F.col("n_control").cast("double"), F.lit(0.0))
    p2 = F.col("x_treatment") / F.nullif(F.col("n_treatment").cast("double"), F.lit(0.0))
    n = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sizes])) if len(sizes) > 1 else F.lit(int(sizes[0])).cast("bigint")
    rates = aligned.select(segment, p1.alias("p1"), p2.alias("p2"), n.alias("n_per_arm"))
    # z is projected first and the tail expression reads the column, so the
    # (long) tail polynomial is not expanded over the z expression.
    staged = rates.select("*", whatif_z(F.col("p1"), F.col("p2"), F.col("n_per_arm")).alias("z"))
    p = two_sided_p(F.col("z"))
    return staged.select(
        segment,
        F.round(F.col("p1") * F.lit(100.0), 2).alias("p1_pct"),
        F.round(F.col("p2") * F.lit(100.0), 2).alias("p2_pct"),
        "n_per_arm",
        F.round("z", 3).alias("z_stat"),
        F.round(p, 5).alias("p_value"),
        (p < F.lit(alpha)).alias("is_significant"),
    )


def summary_text(stats: DataFrame, alpha: float = K.ALPHA) -> DataFrame:
    """The nine-line text report (one row, column ``summary``).

    Lifts print their real sign and the level follows alpha; with a positive
    lift at alpha = 0.05 the text equals the classic report.
    """
    L = K.AB_TEXT_LINES
    level = F.lit(int(round((1.0 - alpha) * 100)))

    def sign(c: str) -> Column:
        return F.when(F.col(c) >= 0, F.lit("+")).otherwise(F.lit(""))

    verdict = F.when(F.col("is_significant"), F.lit(K.AB_SIGNIFICANT)).otherwise(F.lit(K.AB_NOT_SIGNIFICANT))
    lines = [
        F.format_string(L[0], F.col("p_control") * 100, F.col("n_control")),
        F.format_string(L[1], F.col("p_treatment") * 100, F.col("n_treatment")),
        F.format_string(L[2], sign("abs_lift_pp"), F.col("abs_lift_pp")),
        F.format_string(L[3], sign("rel_lift_pct"), F.col("rel_lift_pct")),
        F.format_string(L[4], level, F.col("ci_lower_pp"), F.col("ci_upper_pp")),
        F.format_string(L[5], F.col("z_stat")),
        F.format_string(L[6], F.col("p_value")),
        F.format_string(L[7], F.col("cohens_h")),
        F.format_string(L[8], verdict, level),
    ]
    return stats.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("summary"))


def ab_summary_text(users: DataFrame, events: DataFrame, alpha: float = K.ALPHA) -> DataFrame:
    return summary_text(two_proportion_stats(align_arms(ab_readout(users, events)), alpha), alpha)
