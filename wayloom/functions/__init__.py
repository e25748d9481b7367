"""Scalar functions, codes and catalogs."""
