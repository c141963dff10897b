"""Review-text analytics on PySpark: clean, label, report, train and evaluate."""
