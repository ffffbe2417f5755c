"""Carriers, runs and catalogues the operators read from and write to."""
