"""The staged analysis pipeline and the views on its results."""
