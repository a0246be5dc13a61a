"""Wavemill: a Spark-native engine for multichannel biosignal recordings."""
