"""Brindle: a Spark-native engine for primary-keyed, versioned tables."""
