"""docflow: document-image processing and training-data preparation on PySpark DataFrames."""
