"""Find sensitive spans in text and documents and redact or mark them, on Spark DataFrames."""
