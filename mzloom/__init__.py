"""LC-MS/MS analytics and training-data operators on PySpark DataFrames."""
