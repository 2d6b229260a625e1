"""Operators over typed columns (typed.py), over records of any shape (records.py), and by position (order.py)."""
