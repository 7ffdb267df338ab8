"""Code analytics on DataFrames: a source tree as tables, its questions as Catalyst plans."""
