"""Trial-text retrieval, matching and scoring analytics on PySpark DataFrames."""
