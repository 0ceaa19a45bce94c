"""Structured streams of quality history: an extension of the batch operators."""
