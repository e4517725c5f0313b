"""Analytics over traces of LLM and agent applications, as Spark DataFrames."""

__version__ = "0.1.0"
