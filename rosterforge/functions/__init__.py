"""Column helpers shared by the operators; built-in expressions only."""
