"""Part of terraloom."""
