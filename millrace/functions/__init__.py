"""Column builders; all but the named exceptions stay within Catalyst."""
