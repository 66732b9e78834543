"""Registered queries over the test tables, each with SQL that must give the same rows."""
