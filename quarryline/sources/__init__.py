"""Reading files and payloads into DataFrames, and writing them as tables or snapshots."""
