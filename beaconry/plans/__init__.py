"""Bindings of the operators to the sample tables, with SQL twins for checking."""
