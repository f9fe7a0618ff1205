"""Sources: files and tasks to DataFrames."""
