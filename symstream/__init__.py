"""Spark-native analytics over symbol streams: context models, codelengths, search and text tables."""
