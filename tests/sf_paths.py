"""Folders of the supplied tables (a module of its own: the name ``conftest`` is shared by every test folder)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
