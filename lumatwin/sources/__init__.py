"""Where files, settings and logs are read from."""
