"""Runnable jobs: each is a function taking a session and plain paths, with a command line and a config file."""
