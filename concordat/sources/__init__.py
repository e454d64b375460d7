"""Readers and checks of tabular documents."""
