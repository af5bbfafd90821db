"""Point-in-time market research on Spark: every operator is a DataFrame -> DataFrame function."""
