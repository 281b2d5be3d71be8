"""Training-data operators: one module per operator, all ``DataFrame -> DataFrame``; nothing outside imports this folder."""
