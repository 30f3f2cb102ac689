"""threadlake: session-recall and transcript analytics as Spark jobs."""
