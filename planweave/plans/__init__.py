"""Plans and registered queries."""
