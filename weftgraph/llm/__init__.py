"""Operators for training data from code and the texts around it. Nothing outside imports this subpackage."""
