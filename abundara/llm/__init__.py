"""Training-data operators: one module per operator plus shared helpers.

Nothing outside this subpackage imports it; deleting the folder leaves the rest working.
"""
