"""Part of passagelake; see README.md."""
