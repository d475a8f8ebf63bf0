"""Spark-native analytics over tables, intervals, sequences, alignments and trees."""
