"""Readers and writers: configuration text, binary formats, landed JSON pages."""
