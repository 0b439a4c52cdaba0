"""Runnable jobs: a function that takes a session, a command line around it, and a small file of settings each."""
