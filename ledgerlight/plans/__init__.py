"""Typed plans, the semantic model, the binder and the executor."""
