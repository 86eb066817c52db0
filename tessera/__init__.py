"""tessera: registers, citations, graphs, retrieval and audits as Spark plans."""
