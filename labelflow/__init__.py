"""Labelled-text experiments as Spark jobs: clean, split, prompt, score, measure."""
