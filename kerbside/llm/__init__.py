"""Operators that prepare text and vectors of the feeds for model training; one module each."""
