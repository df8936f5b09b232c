"""Event streams as series."""
