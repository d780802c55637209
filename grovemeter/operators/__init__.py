"""Tree, usage, history and report operators over snapshot entries."""
