"""Graph analytics and job-log operators on Spark DataFrames."""

from .graph import Graph

__all__ = ["Graph"]
__version__ = "0.1.0"
