"""kindred: near-duplicate analytics as Spark DataFrame plans."""
