"""Scalar functions: byte encodings, hashes and bucket arithmetic."""
