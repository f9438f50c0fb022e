"""Training-data operators: licence scans, chat formatting, mixing, URL filters, quality rules, decontamination, extraction, WARC, secret scans and the Jaccard join.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
