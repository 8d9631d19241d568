"""Column expressions: deterministic hashing, guarded ratios, recoding rules."""
