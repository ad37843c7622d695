"""A Spark-native engine for versioned document retrieval and training-data preparation."""
