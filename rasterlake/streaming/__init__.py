"""Image files as a stream, and windowed counts of animation frames."""
