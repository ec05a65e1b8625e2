"""Training-data operators: language id, packing, deduplication, scans, quality, decontamination.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` are what the entry file registers.
"""
