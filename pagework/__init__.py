"""Spark jobs that turn tables of fetched web pages into self-contained offline copies."""
