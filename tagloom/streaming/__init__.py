"""Stateful operators over streams of frames."""
