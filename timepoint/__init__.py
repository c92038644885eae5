"""Transit reliability analytics as composable Spark DataFrame operators."""
