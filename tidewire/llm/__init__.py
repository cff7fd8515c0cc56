"""Training-data operators. Nothing else in tidewire imports this subpackage."""
