"""DataFrame-in, DataFrame-out operators for evidence-backed hypothesis work on Spark."""
