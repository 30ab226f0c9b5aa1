"""Retention analytics as Spark jobs over users, content, watch history and ratings."""
