"""Emergency-department triage analytics on Spark DataFrames."""
