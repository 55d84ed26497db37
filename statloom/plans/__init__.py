"""The operators bound to the given tables, one query each, with equivalent SQL."""
