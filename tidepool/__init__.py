"""Keyed-event upsert engine and data operators on PySpark DataFrames."""
