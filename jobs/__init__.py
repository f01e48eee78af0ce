"""Runnable jobs over the tables; each has a command line, a config file beside it and a run() that takes a session."""
