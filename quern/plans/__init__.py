"""SPARQL SELECT as DataFrame plans: text -> syntax -> algebra -> DataFrame; Catalyst does the rest."""
