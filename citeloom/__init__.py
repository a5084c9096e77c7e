"""citeloom: a Spark-native engine for bibliographic and document data quality."""
