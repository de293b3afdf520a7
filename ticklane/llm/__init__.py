"""Training-data operators: ten stand-alone Spark operators over document, page and vector tables.

Nothing else in the library imports this package, and it imports nothing from the rest of the library.
"""
