"""Where the tests find their tables (imported by test modules; conftest.py holds fixtures only)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
