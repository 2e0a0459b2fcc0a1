"""What runs over rows: positions, selections, indexes, validation."""
