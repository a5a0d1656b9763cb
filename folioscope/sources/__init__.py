"""Readers and writers of the tables the engine works on."""
