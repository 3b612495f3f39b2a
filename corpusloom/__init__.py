"""corpusloom: text and source-code corpus analytics on PySpark DataFrames."""

__version__ = "0.1.0"
