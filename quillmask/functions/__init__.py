"""Scalar building blocks: text normal forms, word lists, span algebra, check digits."""
