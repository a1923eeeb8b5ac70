"""Where triples come from: quad tables, RDF files, link files, and relational tables seen as triples."""
