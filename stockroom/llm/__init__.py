"""Operators on the way to training data; nothing else in the package imports this subpackage."""
