"""Training-data operators.

Nothing outside this folder imports it: the rest of the library works
without it.
"""
