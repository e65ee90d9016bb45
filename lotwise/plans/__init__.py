"""Composite jobs, sizing guards and the registered query catalog."""
