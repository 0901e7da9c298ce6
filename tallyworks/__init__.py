"""Quality and retention analytics as Spark DataFrame operators."""
