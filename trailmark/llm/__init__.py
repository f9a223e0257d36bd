"""Training-data operators: filters, extraction, de-duplication, packing.

Nothing else in the library imports this subpackage.
"""
