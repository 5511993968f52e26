"""Readers, writers and adapter views."""
