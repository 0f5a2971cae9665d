"""Where frames, captures, signals and models come from."""
