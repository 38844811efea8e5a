"""Registered queries of the library and the SQL they are checked against."""
