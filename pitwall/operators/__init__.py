"""DataFrame-to-DataFrame operators: channels, laps, events, segments, statistics, setups."""
