"""A Spark-native engine for corpus graphs and multi-hop question sets."""
