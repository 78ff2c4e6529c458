"""loomspan: a document-intelligence query engine on PySpark DataFrames."""
