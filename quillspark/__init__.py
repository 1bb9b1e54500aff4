"""Spark-native document intelligence: sources, text operators, retrieval, ledgers, crawls."""
