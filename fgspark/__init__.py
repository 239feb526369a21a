"""fgspark: factor graphs as DataFrames, and queries over them as Spark jobs."""
