"""Statement-policy analytics and training-data preparation on PySpark."""
