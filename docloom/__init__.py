"""A Spark-native engine for versioned collections of Markdown documents."""
