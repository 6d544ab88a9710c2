"""Operators for preparing training text at scale; see README for methods and figures."""
