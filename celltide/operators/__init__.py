"""Verbs and relational operators of the gridded statistics engine."""
