"""graphloom: property-graph analytics over code and change history, on Spark DataFrames."""
