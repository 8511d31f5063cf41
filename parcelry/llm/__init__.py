"""Operators for preparing text corpora: mixing, sharding, language, tokens, licences, HTML, near copies, quality,
benchmark leaks and repeated lines. Nothing else in the library imports this subpackage."""
