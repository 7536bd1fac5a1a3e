"""Spark-native analytics for small-body catalogues: operators are plain ``DataFrame -> DataFrame`` functions."""
