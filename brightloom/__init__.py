"""Disclosure and text-evidence analytics on Spark."""
