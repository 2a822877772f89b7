"""Query plans over the project's tables, by name, with their SQL where SQL can say the same."""
