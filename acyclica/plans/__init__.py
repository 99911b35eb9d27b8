"""How queries run: checkpoints between rounds, deadlines, size limits, whole solving plans."""
