"""docloom: document ingestion, retrieval and knowledge-graph operators on Spark SQL.

Every operator is a function from DataFrames to a DataFrame.  Nothing here starts an action
unless its docstring says so.
"""
