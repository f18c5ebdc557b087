"""Set-at-a-time analytics over the execution traces of tool-calling agents, on PySpark."""

__version__ = "0.1.0"
