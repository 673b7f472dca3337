"""galena: a Spark-native analytics engine for file catalogues."""
