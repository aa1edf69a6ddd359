"""Condition-monitoring analytics expressed as Spark plans."""
