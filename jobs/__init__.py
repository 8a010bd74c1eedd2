"""Runnable jobs: a function taking a session, a command line and a config file each."""
