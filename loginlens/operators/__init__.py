"""DataFrame operators over login events."""
