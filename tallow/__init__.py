"""tallow: a Spark-native analytics engine for market time series."""
