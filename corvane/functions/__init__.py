"""Functions on single values: tokens, hashes, and text clean-up."""
