"""Plans composed from operators, and the domain views they read."""
