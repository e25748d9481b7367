"""Readers and writers of map documents."""
