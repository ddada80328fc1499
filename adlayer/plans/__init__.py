"""Registered queries, the SQL that checks them, and command lines."""
