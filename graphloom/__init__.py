"""graphloom: knowledge-graph analytics and retrieval as lazy Spark DataFrames."""

__version__ = "0.1.0"
