"""tidewheel: Spark-native analytics over durable work-queue data."""
