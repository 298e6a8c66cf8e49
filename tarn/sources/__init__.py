"""Readers, writers and adapters from tables to the entities that operators work on."""
