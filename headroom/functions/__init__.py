"""Expressions that relations share: formats and phrases."""
