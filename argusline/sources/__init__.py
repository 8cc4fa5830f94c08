"""Readers and writers of memory, images and messages."""
