"""Types, fills, codecs and names: what holds for one column or one value."""
