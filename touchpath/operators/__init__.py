"""DataFrame-to-DataFrame operators: cleaning, identity, windows, attribution, routes."""
