"""lodegraph: versioned property-graph analytics on Spark DataFrames.

Every operator is a plain function from DataFrames to a DataFrame.  The
subpackage ``llm`` holds the text and training-data operators; nothing outside
it imports it.
"""

__version__ = "0.1.0"
