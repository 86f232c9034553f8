"""Millrace: a Spark-native engine for framed, bit-packed replay recordings and ordered event tables."""
