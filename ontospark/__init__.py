"""ontospark: RDF graph and OWL ontology analytics as PySpark DataFrame plans."""
