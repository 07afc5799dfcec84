"""Citation-impact analytics as Spark DataFrame transformations."""

from laurel.config import MetricConfig

__all__ = ["MetricConfig"]
