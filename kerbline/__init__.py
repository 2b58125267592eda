"""Spark-native analytics for driving logs, trajectories and the text that describes them."""
