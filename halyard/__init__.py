"""halyard: photo-collection analytics on Spark DataFrames."""
