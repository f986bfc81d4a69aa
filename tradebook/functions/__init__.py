"""Column -> Column helpers.  No function here triggers a job or a shuffle."""
