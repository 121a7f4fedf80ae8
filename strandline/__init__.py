"""Strandline: activity analytics and corpus operators as Spark jobs."""
