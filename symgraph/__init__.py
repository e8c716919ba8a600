"""A symbol-graph and table-graph analytics engine on Spark DataFrames."""
