"""Operators that prepare a text corpus for training; nothing else in the library imports them."""
