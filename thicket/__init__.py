"""Path-forest analytics as DataFrame-to-DataFrame transformations."""
