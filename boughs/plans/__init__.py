"""Paths, types and schemas: what is known about records before any data is read."""
