"""Column functions whose exact semantics the jobs depend on."""
