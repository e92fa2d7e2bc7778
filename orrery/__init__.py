"""orrery: a Spark-native engine for product-catalogue and web-harvest data."""
