"""The same rules and models applied to files and documents as they arrive."""
