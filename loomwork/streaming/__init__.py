"""The event log and token fragments as streams."""
