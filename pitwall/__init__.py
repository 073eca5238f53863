"""Vehicle-telemetry analytics on PySpark: every operator is a DataFrame transformation."""

__version__ = "0.1.0"
