"""Part of lodesieve; see the README for the layout."""
