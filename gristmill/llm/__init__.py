"""Operators of a training-data pipeline over very large document tables.

Nothing outside this subpackage imports it. ``entries`` holds the registered
queries; every other module holds one operator with a general interface.
"""
