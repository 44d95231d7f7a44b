"""Tables of bars, raw rows and quotes, from files and from the driver's tables."""
