"""Part of the augury package."""
