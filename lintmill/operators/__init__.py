"""Rules, scoring, catalogue queries, reports and maintenance."""
