"""weftgraph: analytics on branch-aware code graphs, built on Spark DataFrames."""

__version__ = "0.1.0"
