"""Where the smallest tables are, for tests that read them."""

DATA = "/root/testdata/sf0.001"
