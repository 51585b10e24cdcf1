"""KPI row and dashboard payload, both from one stored fact table and its sums.

``Analyses`` reads the model once (``facts.user_facts``), adds it up once (``facts.summary_cells``, a few
rows a channel, arm and cohort month) and derives every section from these few rows. The
lists in the payload are bounded by dimensions (channels, cohort months x 4, arms, five checks, top 10): one
JSON document holds them all, so their dimensions are assumed to be such that one document can.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import Model
from . import churn, experiment, facts, funnel, quality, retention, revenue


class Analyses:
    """The analyses of one model, from its facts and their sums. ``stored_facts`` and ``early`` (one row of
    ``quality.count_early_events``): as kept by ``state.ModelState``, instead of a pass over the model. Making one runs the jobs that
    store the facts and their sums."""

    def __init__(self, model: Model, stored_facts: DataFrame | None = None, early: DataFrame | None = None):
        self.model = model
        self.facts = facts.user_facts(model) if stored_facts is None else stored_facts
        self.cells = facts.summary_cells(self.facts)
        self._early = early

    def _of(self, kind: str) -> DataFrame:
        return self.cells.where(F.col("kind") == kind)

    @cached_property
    def funnel(self) -> DataFrame:
        stages = [dst for dst, _ in facts.STAGES]
        return funnel.funnel_table(self._of("channel").select(F.col("k1").alias("channel"), F.col("users").alias("signups"), *stages), ordered=False)

    @cached_property
    def revenue(self) -> DataFrame:
        paid = F.col("paying").alias("paying_users")
        return revenue.revenue_rates(
            self._of("channel").select(F.col("k1").alias("channel"), F.col("users").alias("total_signups"), paid, "rev", "annual_rev"), ordered=False
        )

    @cached_property
    def readout(self) -> DataFrame:
        return experiment.readout_table(
            self._of("group").select(F.col("k1").alias("experiment_group"), "users", F.col("onboarded").alias("activated"))
        )

    @cached_property
    def ab(self) -> DataFrame:
        return experiment.publish(experiment.two_proportion_stats(experiment.align_arms(self.readout)))

    @cached_property
    def retention(self) -> DataFrame:
        return retention.retention_table(
            self._of("active").select(F.col("k1").alias("cohort_month"), F.col("k2").alias("month_number"), F.col("users").alias("retained_users")),
            self._of("cohort").select(F.col("k1").alias("cohort_month"), F.col("users").alias("cohort_users")),
        )

    @cached_property
    def report(self) -> DataFrame:
        counts = self._of("all").agg(
            F.sum(F.col("copies") - F.col("users")).alias("duplicate_count"),
            *(F.sum(c).alias(c) for c in ("orphan_events", "orphan_bills", "bad")),
        )
        early = self._early
        if early is None:
            broken = self.facts.where(F.col("first_event") < F.col("last_signup")).select("user_id")
            early = quality.count_early_events(self.model.users, self.model.events, broken)
        return quality.report_table(counts, early)

    @cached_property
    def rollup(self) -> DataFrame:
        """A row for an empty model, too."""
        scored = F.sum(F.col("high") + F.col("medium") + F.col("low"))
        return self._of("all").agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_risk_count") for c in ("high", "medium", "low")),
            F.coalesce(F.round(F.sum("risk") / F.nullif(scored, F.lit(0)), 1), F.lit(0.0)).alias("avg_churn_risk_pct"),
        )

    @cached_property
    def at_risk(self) -> DataFrame:
        people = facts.scored(self.facts.where(F.col("dims").isNotNull()))
        return churn.at_risk_users(people.withColumn("channel", F.col("one_channel")))


def combine_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Put one-row frames with distinct columns side by side, in one plan.

    ``unionByName`` (missing columns become NULL) followed by one global
    aggregate that keeps the single non-NULL value of every column. The final
    aggregate sees one row per section; every section reads the few stored sums.
    """
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def kpi_sections(a: Analyses) -> list[DataFrame]:
    return [
        a.funnel.agg(
            F.sum("signups").cast("bigint").alias("total_signups"),
            F.sum("subscribed").cast("bigint").alias("total_paying_users"),
        ),
        a.revenue.agg(F.round(F.sum("total_revenue_usd"), 2).alias("total_revenue")),
        a.ab.select(
            F.col("abs_lift_pp").alias("ab_lift_pp"),
            F.col("p_value").alias("ab_p_value"),
            F.col("is_significant").alias("ab_is_significant"),
        ),
        quality.all_passed(a.report).select(F.col("all_passed").alias("dq_all_passed")),
        a.rollup.select("avg_churn_risk_pct", F.col("high_risk_count").alias("high_churn_users_count")),
    ]


def kpi_columns(
    signups: Column | None = None,
    paid: Column | None = None,
    revenue_total: Column | None = None,
    ab_lift: Column | None = None,
    ab_p: Column | None = None,
    ab_sig: Column | None = None,
    dq_passed: Column | None = None,
    churn_mean: Column | None = None,
    churn_high: Column | None = None,
) -> list[Column]:
    """The KPI row from its inputs (by default the columns of ``kpi_sections``)."""

    def c(value, name):
        return F.col(name) if value is None else value

    signups, paid = c(signups, "total_signups"), c(paid, "total_paying_users")
    revenue_total, ab_lift, ab_p = c(revenue_total, "total_revenue"), c(ab_lift, "ab_lift_pp"), c(ab_p, "ab_p_value")
    ab_sig, dq_passed = c(ab_sig, "ab_is_significant"), c(dq_passed, "dq_all_passed")
    churn_mean, churn_high = c(churn_mean, "avg_churn_risk_pct"), c(churn_high, "high_churn_users_count")
    conversion = F.when(
        signups > 0, F.round(paid.cast("double") / signups * F.lit(100.0), 2)
    ).otherwise(F.lit(0.0))
    return [
        signups.alias("total_signups"),
        revenue_total.alias("total_revenue"),
        paid.alias("total_paying_users"),
        conversion.alias("overall_conversion_pct"),
        ab_lift.alias("ab_lift_pp"),
        ab_p.alias("ab_p_value"),
        ab_sig.alias("ab_is_significant"),
        dq_passed.alias("dq_all_passed"),
        churn_mean.alias("avg_churn_risk_pct"),
        churn_high.alias("high_churn_users_count"),
    ]


def _array_sum(arr: Column, field: str, zero: Column) -> Column:
    """SQL SUM over one field of an array of structs: NULLs skipped, NULL if all are NULL."""
    total = F.aggregate(arr, zero, lambda acc, x: acc + F.coalesce(x[field], zero))
    return F.when(F.exists(arr, lambda x: x[field].isNotNull()), total)


def kpi_summary(model: Model, analyses: Analyses | None = None) -> DataFrame:
    """total signups / revenue / paying users, overall conversion, A/B lift and p,
    decision, all checks passed, mean churn risk, high-risk users: one row."""
    a = analyses or Analyses(model)
    return combine_rows(kpi_sections(a)).select(*kpi_columns())


def _down(column: str) -> list[Column]:
    """Sort keys for descending order, NULL last."""
    return [F.col(column).isNull(), -F.col(column)]


def _sorted_list(df: DataFrame, order: Sequence[Column], cols: Sequence[str], name: str) -> DataFrame:
    """Bounded section as a one-row frame holding an ordered array of structs."""
    keyed = df.select(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.struct(*cols).alias("row")).alias("x"))
    return keyed.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.getField("row")).alias(name))


def dashboard_payload(
    model: Model, saved_sql: Mapping[str, str], title: str = "product analytics", analyses: Analyses | None = None
) -> DataFrame:
    """One row, column ``payload``: the whole dashboard document as JSON."""
    a = analyses or Analyses(model)
    # the KPI block is derived from the lists below (no separate sections)
    sections = [
        _sorted_list(a.funnel, [*_down("overall_conversion_pct"), F.col("channel")], a.funnel.columns, "funnel"),
        _sorted_list(a.retention, [F.col("cohort_month"), F.col("month_number")], a.retention.columns, "cohort"),
        _sorted_list(a.revenue, [*_down("revenue_per_signup_usd"), F.col("channel")], a.revenue.columns, "revenue"),
        _sorted_list(a.readout, [F.col("experiment_group")], a.readout.columns, "groups"),
        _sorted_list(a.report, [F.col("check_order")], ["check_name", "passed", "details"], "data_quality"),
        _sorted_list(a.at_risk, [*_down("risk_score"), F.col("user_id")], a.at_risk.columns, "at_risk_users"),
        a.ab.select(F.struct(*a.ab.columns).alias("result")),
        a.rollup.select(*[F.col(c).alias(f"churn_{c}") for c in a.rollup.columns]),
    ]
    wide = combine_rows(sections)
    queries = F.create_map(*[F.lit(x) for kv in sorted(saved_sql.items()) for x in kv])
    doc = F.struct(
        F.lit(title).alias("title"),
        F.struct(*kpi_columns(
            signups=_array_sum(F.col("funnel"), "signups", F.lit(0).cast("bigint")),
            paid=_array_sum(F.col("funnel"), "subscribed", F.lit(0).cast("bigint")),
            revenue_total=F.round(_array_sum(F.col("revenue"), "total_revenue_usd", F.lit(0.0)), 2),
            ab_lift=F.col("result.abs_lift_pp"),
            ab_p=F.col("result.p_value"),
            ab_sig=F.col("result.is_significant"),
            dq_passed=F.forall(F.col("data_quality"), lambda x: x["passed"]),
            churn_mean=F.col("churn_avg_churn_risk_pct"),
            churn_high=F.col("churn_high_risk_count"),
        )).alias("summary"),
        F.col("funnel"),
        F.col("cohort"),
        F.struct(F.col("groups"), F.col("result")).alias("ab_test"),
        F.col("revenue"),
        queries.alias("queries"),
        F.col("data_quality"),
        F.struct(
            F.col("churn_high_risk_count").alias("high_risk_count"),
            F.col("churn_medium_risk_count").alias("medium_risk_count"),
            F.col("churn_low_risk_count").alias("low_risk_count"),
            F.col("churn_avg_churn_risk_pct").alias("avg_churn_risk_pct"),
            F.col("at_risk_users"),
        ).alias("churn"),
    )
    return wide.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"))


def payload_long(model: Model, analyses: Analyses | None = None) -> DataFrame:
    """The payload's lists as rows (section, position, key, value): position from 1 in the list's order, value as
    text, a row a field, NULL values included."""
    a = analyses or Analyses(model)
    lists = [
        ("funnel", a.funnel, [*_down("overall_conversion_pct"), F.col("channel")], a.funnel.columns),
        ("cohort", a.retention, [F.col("cohort_month"), F.col("month_number")], a.retention.columns),
        ("revenue", a.revenue, [*_down("revenue_per_signup_usd"), F.col("channel")], a.revenue.columns),
        ("groups", a.readout, [F.col("experiment_group")], a.readout.columns),
        ("data_quality", a.report, [F.col("check_order")], ["check_name", "passed", "details"]),
        ("at_risk_users", a.at_risk, [*_down("risk_score"), F.col("user_id")], a.at_risk.columns),
    ]
    out = None
    for name, df, order, cols in lists:
        fields = F.array(*(F.struct(F.lit(c).alias("key"), as_text(df, c).alias("value")) for c in cols))
        listed = _sorted_list(df.select("*", fields.alias("fields")), order, ["fields"], "rows")
        rows = listed.select(F.posexplode("rows").alias("at", "row")).select(
            F.lit(name).alias("section"), (F.col("at") + 1).alias("position"), F.explode("row.fields").alias("f")
        )
        rows = rows.select("section", "position", "f.key", "f.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def as_text(df: DataFrame, c: str) -> Column:
    """Numbers with four decimals, other values as they are."""
    kind = df.schema[c].dataType.typeName()
    return F.format_string("%.4f", F.col(c).cast("double")) if kind in ("double", "long", "integer") else F.col(c).cast("string")
