"""Plans: training loops, inference, evaluation, and the query catalog."""
