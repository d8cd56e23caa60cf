"""Readers, writers and the binding of the test tables to the raw inputs."""
