"""quirelake: document-structure analytics on Spark DataFrames."""
