"""No streaming operator: the capability set has none; every operator here is a batch plan."""
