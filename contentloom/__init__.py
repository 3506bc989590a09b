"""Content, event-log and peer analytics on PySpark DataFrames."""
