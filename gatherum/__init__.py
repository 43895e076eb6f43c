"""Gatherum: a Spark-native analytics engine for document collections and the registers that describe them."""
