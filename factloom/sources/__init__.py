"""Tables and files: reading and writing."""
