"""Text, name and document operators for training data. Nothing outside this subpackage imports it."""
