"""Belegwerk: bulk checking of extracted invoice data on Spark DataFrames."""
