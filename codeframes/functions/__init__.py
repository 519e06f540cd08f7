"""Part of codeframes."""
