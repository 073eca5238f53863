"""Recorded-session sources: binary replays, setup files, segment definitions."""
