"""From metric lists to DataFrame plans, and the registered queries."""
