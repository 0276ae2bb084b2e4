"""Named datasets of the two analyses, each a function of input frames."""
