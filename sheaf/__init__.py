"""sheaf: document analytics and matching on PySpark DataFrames."""
