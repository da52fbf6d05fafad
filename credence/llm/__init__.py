"""Training-data operators: ten stand-alone corpus operators and their queries.

Nothing outside this subpackage imports it.
"""
