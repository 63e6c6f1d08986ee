"""Dataset-partition auditing on Spark: groups, duplicates, splits, leakage and metrics as DataFrame plans."""
