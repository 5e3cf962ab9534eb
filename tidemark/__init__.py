"""tidemark: conversation-record analytics and data processing on Spark DataFrames."""
