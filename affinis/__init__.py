"""affinis: similarity self-joins and the data preparation around them, on PySpark DataFrames."""
