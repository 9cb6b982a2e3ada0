"""All queries register themselves when their module is imported."""
