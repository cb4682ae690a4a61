"""Registered queries, the tables they read and the SQL they must agree with."""
