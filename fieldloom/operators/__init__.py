"""Table operators: every function here takes and returns DataFrames."""
