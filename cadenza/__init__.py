"""cadenza: a PySpark-native analytics engine for programme and event archives."""
