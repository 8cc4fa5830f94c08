"""Visual-inspection analytics as composable Spark DataFrame operators."""
