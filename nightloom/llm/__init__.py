"""Training-data operators. Nothing else in nightloom imports this subpackage."""
