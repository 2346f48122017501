"""Change logs: replay in batch, recovery from files, and a stream that keeps a table up to date."""
