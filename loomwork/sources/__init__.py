"""Where values come from and go to: seeds, files, model backends, event and fixture tables."""
