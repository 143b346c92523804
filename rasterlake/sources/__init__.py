"""Image files as rows: reading, decoding, encoding and writing."""
