"""Ranking and analytics over versioned document corpora, written as Spark jobs."""
