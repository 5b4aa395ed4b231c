"""Column builders: names, predicates, schedules, scores and text."""
