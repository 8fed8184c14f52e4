"""Multi-view scoring, drift and signature analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
