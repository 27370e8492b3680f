"""Select-project-join-aggregate queries on Spark, defined once and run in batch or kept current over streams."""
