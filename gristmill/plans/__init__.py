"""The query plan: its grammar, binding to a catalogue, and compilation to a DataFrame."""
