"""Readers of saved provider payloads, and writers."""
