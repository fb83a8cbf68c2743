"""Reading and writing ads, prompt records and result files."""
