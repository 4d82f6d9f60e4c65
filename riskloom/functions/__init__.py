"""Column expressions: no I/O, no actions, no Python workers."""
