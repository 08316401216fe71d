"""Part of sealwork."""
