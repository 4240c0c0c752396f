"""Registered queries: one per operator, with the SQL they are checked against."""
