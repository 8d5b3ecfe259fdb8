"""The layers put together: lazily as queries, or stored step by step."""
