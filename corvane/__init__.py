"""A Spark-native engine for document ingestion, hybrid retrieval and chat analytics."""
