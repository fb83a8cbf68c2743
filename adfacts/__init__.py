"""Facts from job advertisements, as DataFrame and Column functions."""
