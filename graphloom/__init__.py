"""graphloom: temporal dependency-graph analytics and training-data operators on Spark."""

__version__ = "0.1.0"
