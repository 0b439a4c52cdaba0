"""Scalar expressions and small driver-side functions."""
