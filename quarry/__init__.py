"""quarry: a document query and analytics engine on Spark DataFrames."""
