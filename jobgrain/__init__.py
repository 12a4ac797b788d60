"""PySpark library for large collections of job postings: DataFrame in, DataFrame out."""
