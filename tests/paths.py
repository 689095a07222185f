"""Folders of the given tables, imported by name (a test module's own ``conftest`` may be another one)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
