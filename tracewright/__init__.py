"""tracewright: text-memory analytics as composable PySpark DataFrame operators."""
