"""Table, document and file operators over DataFrames."""
