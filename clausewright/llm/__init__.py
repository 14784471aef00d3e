"""Operators that prepare training text: quality, rules, packing, archives, duplicates, language, secrets, URLs, benchmarks."""
