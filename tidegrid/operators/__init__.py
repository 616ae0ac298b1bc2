"""Panel algebra, windows, moments and cross-sections as DataFrame operations."""
