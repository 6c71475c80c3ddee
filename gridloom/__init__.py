"""Grid-telemetry analytics on PySpark."""
