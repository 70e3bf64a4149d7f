"""Operators for preparing training data; nothing else in quirefold imports them."""
