"""Tables the jobs read and write."""
