"""Part of Tomeweave."""
