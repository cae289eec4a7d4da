"""Part of spectraloom, a Spark-native signals analytics library."""
