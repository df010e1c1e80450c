"""Files in and out: CSV scan and export, previews, recipe log."""
