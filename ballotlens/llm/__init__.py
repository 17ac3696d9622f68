"""Training-data operators: tokenisation, de-duplication, scans, search.

Nothing else in the library imports this subpackage."""
