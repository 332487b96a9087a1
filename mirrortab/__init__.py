"""Make and judge synthetic tables with Spark DataFrames."""
