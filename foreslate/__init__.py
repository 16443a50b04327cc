"""Walk-forward forecasting and ratings, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
