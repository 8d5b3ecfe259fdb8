"""Medallion analytics on Spark: typed Bronze, cleaned Silver, Gold star schema."""
