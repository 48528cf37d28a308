"""A Spark-native engine for labelled time-series metrics and the data processing around them."""
