"""presswork: article extraction, de-duplication and catalog queries on Spark.

Everything is a function from DataFrames (or Columns) to DataFrames (or
Columns); nothing here starts a session, and only the iterative de-dup and the
deep-paging seek run a job of their own.
"""
