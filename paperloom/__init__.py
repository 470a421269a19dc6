"""paperloom: document and message analytics as Spark DataFrame operators."""
