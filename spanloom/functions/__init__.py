"""Column expressions; all native except ``functions.privacy``."""
