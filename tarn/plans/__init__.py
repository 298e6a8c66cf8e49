"""Registered queries with the SQL that an oracle runs on the same tables."""
