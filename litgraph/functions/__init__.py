"""Column functions: text normalisation, vocabularies and scores."""
