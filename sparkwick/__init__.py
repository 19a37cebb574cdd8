"""Candle analytics as Spark DataFrame transformations."""

from sparkwick.config import AnalysisConfig, Layout

__all__ = ["AnalysisConfig", "Layout"]
