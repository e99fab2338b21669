"""DataFrame operators over canonical event, sync and metric tables."""
