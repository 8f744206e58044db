"""A Spark-native engine for searching and analysing document collections."""
