"""lectio: document intelligence as declarative Spark plans."""
