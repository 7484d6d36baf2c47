"""Table loaders, role views over them, and readers of foreign formats."""
