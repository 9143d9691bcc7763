"""A Spark-native engine for record migration, data quality and corpus preparation."""
