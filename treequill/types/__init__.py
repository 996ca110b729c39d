"""Simple types: lexical spaces, casts and facets as SQL expressions."""
