"""Context-coverage analytics on Spark."""
