"""Cataloom: a catalogue integration and hybrid retrieval engine on PySpark."""
