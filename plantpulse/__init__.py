"""Condition-monitoring analytics for industrial network nodes, as Spark DataFrame operators."""
