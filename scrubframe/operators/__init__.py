"""Table-level operators: every function takes and returns DataFrames."""
