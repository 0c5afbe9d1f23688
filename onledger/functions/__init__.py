"""Column expressions: decoding, guards, time, exact integers."""
