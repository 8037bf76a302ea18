"""Spark jobs for labelled signal captures."""
