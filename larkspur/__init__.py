"""larkspur: analytics over agent memory and job-pipeline data, on Spark DataFrames."""
