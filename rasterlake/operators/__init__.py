"""Operators over images, frames and pixels."""
