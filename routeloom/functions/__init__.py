"""Scalar functions: texts of molecules and reactions, chemistry, neural inference."""
