"""A Spark-native engine for points on the globe: Z-order index, radius, box and nearest-neighbour searches, joins."""
