"""Vehicle telemetry analytics as Spark DataFrame plans."""
