"""A Spark-native engine for cleaning, profiling and normalising code-mixed text, and for scoring retrieval over it."""
