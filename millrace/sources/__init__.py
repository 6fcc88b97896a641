"""Reading and writing what the pipelines exchange."""
