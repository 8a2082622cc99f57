"""Op lists applied as a chain of DataFrame transforms, with audit and registry."""
