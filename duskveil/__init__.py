"""A Spark-native engine for private data in text: detection, substitution, verification, restoration, measurement."""
