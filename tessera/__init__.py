"""Analytics over a typed knowledge graph with a bitemporal belief memory, as ordinary Spark plans."""
