"""Operators for corpora of documents, vectors and pages. Nothing outside this subpackage imports it."""
