"""weftline: analytics and training-data operators written on PySpark DataFrames."""
