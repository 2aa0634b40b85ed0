"""Part of recallkit."""
