"""Model frames, derived networks, the API, and the query catalog."""
