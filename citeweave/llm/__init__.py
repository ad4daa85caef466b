"""Training-data operators: one module per operator, their registry in ``queries``."""
