"""Operators for preparing training corpora; each module holds one operator, ``queries`` registers them."""
