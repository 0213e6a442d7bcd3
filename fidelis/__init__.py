"""User-fidelity audit engine on Spark: DataFrame in, DataFrame out, no global session."""
