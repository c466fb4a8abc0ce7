"""DataFrame operators; they import nothing from the sources and run on any table of the right shape."""
