"""The queries this repository answers over the test tables, and the same in plain SQL."""
