"""Operators of a training-data pipeline; nothing else in cadenza imports them."""
