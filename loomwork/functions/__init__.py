"""Types, value rules, canonical forms and the renderings of types for model backends."""
