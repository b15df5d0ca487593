"""Online-shop performance analytics as Spark DataFrame pipelines."""

from shopledger.config import AnalysisConfig

__all__ = ["AnalysisConfig"]
