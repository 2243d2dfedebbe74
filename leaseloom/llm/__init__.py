"""Operators that prepare the books' written findings as training text. Nothing else in the library imports this package."""
