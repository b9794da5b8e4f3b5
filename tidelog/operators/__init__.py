"""Read, merge, policy and report operators: functions from DataFrames to DataFrames."""
