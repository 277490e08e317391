"""Plans composed from configurations, and the case study."""
