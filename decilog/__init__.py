"""Decision-log analytics as Spark DataFrame operators."""
