"""qalam — corpus building and evaluation operators on Spark DataFrames.

Every operator takes and returns a DataFrame (or a Column for scalar steps);
all heavy work runs in Spark joins, aggregations, windows and streaming.
"""

__version__ = "0.1.0"
