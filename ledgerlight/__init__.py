"""Ledgerlight: verified answers and data quality over tables of any size, on Spark."""
