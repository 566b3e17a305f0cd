"""Relational operators: areal units, change of support, bases, variograms, lattices."""
