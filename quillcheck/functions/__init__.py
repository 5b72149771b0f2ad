"""Column functions: text clean-up, string similarity, fixed word lists."""
