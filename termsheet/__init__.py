"""Spark-native analytics over structured-product prospectus filings."""
