"""Training-data operators: each module is one operator, ``queries`` registers them.

Nothing else in the library imports this subpackage."""
