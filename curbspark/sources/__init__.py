"""Landed feeds in, tables and batch folders out."""
