"""lodesieve: sensitive-data scanning and text-corpus analytics on Spark DataFrames."""
