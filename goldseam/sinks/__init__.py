"""Where layers are written, with the row count of every write."""
