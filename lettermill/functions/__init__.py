"""Part of lettermill."""
