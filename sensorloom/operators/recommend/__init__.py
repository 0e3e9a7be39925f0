"""Rule-based recommendations over zones, and their lifecycle."""
