"""Tasks, systems and the registered queries."""
