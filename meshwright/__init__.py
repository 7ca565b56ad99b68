"""meshwright: code-graph and corpus analytics expressed as Spark plans."""
