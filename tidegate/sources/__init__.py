"""Readers and sinks for governed inputs."""
