"""End-to-end runs put together from the operators."""
