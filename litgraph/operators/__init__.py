"""DataFrame operators over papers, extractions, connections, triples and edges."""
