"""tokenloom: tokenizer analytics on Spark DataFrames."""
