"""Reliability analytics on Spark: carving of records into windows, survival and renewal statistics, cycles, spectra and surveys."""
