"""Operators for cleaning and mixing training text: one module per operator, thin queries in ``queries``."""
