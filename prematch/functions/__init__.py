"""Column expressions: text, keys, prices."""
