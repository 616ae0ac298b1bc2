"""Reading, writing and deriving panels."""
