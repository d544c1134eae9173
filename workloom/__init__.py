"""Spark-native analytics for workforce data: reports, matching, search, rules, reference-data loads and pipelines."""
