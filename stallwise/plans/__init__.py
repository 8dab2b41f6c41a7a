"""The jobs: each function takes the tables and returns a DataFrame."""
