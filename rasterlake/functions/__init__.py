"""Column functions over pixels, bytes and file names."""
