"""Column -> Column rules (normalisation, parsing, labels). No Python UDFs."""
