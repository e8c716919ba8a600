"""Runnable jobs; each has a command line and a config file beside it."""
