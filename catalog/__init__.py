"""Named queries over the test tables, each with an independent SQL statement where SQL can express it."""
