"""Code-graph analytics as Spark DataFrame operators."""
