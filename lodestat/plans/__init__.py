"""Whole runs made of operators, and the queries registered for checking and timing."""
