"""cohortlens: product analytics (funnels, cohort retention, experiments,
revenue, data quality, churn risk, exploration) as lazy Spark DataFrames."""

__version__ = "0.1.0"
