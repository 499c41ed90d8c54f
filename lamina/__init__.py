"""Versioned key-value tables on Spark: a log of mutations, sorted runs in levels, and newest-wins reads."""
