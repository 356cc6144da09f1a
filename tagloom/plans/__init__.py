"""Path expressions and their plans."""
