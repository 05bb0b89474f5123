"""Analytics for device-calibration telemetry on PySpark."""
