"""Domain pipelines: targets, features, events, evaluation, trades, live grading."""
