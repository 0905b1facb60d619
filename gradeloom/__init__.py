"""gradeloom: Spark-native evaluation of recorded language-model answers."""
