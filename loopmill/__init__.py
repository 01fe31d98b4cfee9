"""Street-network, loop-route and text-corpus jobs as plain DataFrame transformations."""
