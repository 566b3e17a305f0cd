"""Scalar building blocks: distances, kernels, links and densities as Column expressions with numpy twins."""
