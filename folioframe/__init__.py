"""A Spark-native engine for office-style data: cells, paragraphs, pages, shapes and package parts as DataFrames."""
