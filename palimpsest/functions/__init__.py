"""functions of the versioned key/value engine."""
