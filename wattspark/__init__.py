"""wattspark: Spark-native analytics for device power telemetry.

Every operator takes DataFrames and returns a DataFrame; nothing keeps a global session.
"""

__version__ = "0.1.0"
