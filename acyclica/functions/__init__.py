"""Sequential graph functions for one component that fits a task, and the pandas functions that run them."""
