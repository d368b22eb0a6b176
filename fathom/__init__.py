"""fathom: Spark-native analytics over media-embedding indexes and large text corpora."""
